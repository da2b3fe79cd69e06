"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, read back by memory mapping.

A shard is two files. <name>.bin: the ids of its documents, one after the other, little-endian, in the narrowest
unsigned integers that hold the vocabulary. <name>.idx: 64-bit little-endian integers: a magic number, the width of
an id in bytes, the number n of documents, n document ids, n + 1 offsets in ids. Shards go by ascending doc_id; the
place of a shard's first id among all comes from prefix sums over the shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ready, shared_dir, tidy
from .tokens import encoder

MAGIC = 0x4C4F4445
BATCH = 256
#: Stands for a null doc_id, which comes first.
NULL_ID = -(1 << 63)
SHARDS = "part int, name string, documents long, tokens long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def _put(files, name: str, chunks) -> None:
    """Under another name first, so that a lost or repeated attempt leaves nothing half written."""
    temporary = f"{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as out:
        for chunk in chunks:
            out.write(chunk)
    files.move(temporary, name)


def _write(path: str, uri: str, width: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _filesystem(uri)
        part = TaskContext.get().partitionId()
        name = f"{folder}/shard-{part:06d}"
        codec, tail = encoder("words", path, width), np.array([end], f"<u{width}").tobytes()
        names, sizes = [], []

        def chunks():
            for batch in batches:
                for i in range(0, batch.num_rows, BATCH):
                    names.extend(batch.column("doc").slice(i, BATCH).to_pylist())
                    for ids in codec.encode(batch.column("text").slice(i, BATCH).to_pylist()):
                        sizes.append(len(ids) // width + 1)
                        yield ids + tail

        _put(files, f"{name}.bin", chunks())
        offsets = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64)))).astype("<i8")
        head = np.array([MAGIC, width, len(names), *names], "<i8")
        _put(files, f"{name}.idx", (head.tobytes(), offsets.tobytes()))
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(names)], pa.int64()), pa.array([int(offsets[-1])], pa.int64())], names=["part", "name", "documents", "tokens"])

    return run


def write_token_files(docs: DataFrame, tokenizer: str, uri: str | None = None, vocabulary: int = 49_408, end: int = 2) -> DataFrame:
    """Writes the ids of docs(doc_id, text), each followed by `end`, in ascending doc_id order; returns the shards.

    (part, uri, name, documents, tokens, base): base counts the ids in the shards before. Without uri the files go to a
    new folder in the shared one. A null text is empty; a null doc_id comes first; rows of one doc_id go by a hash of
    their text, and a doc_id that many rows have is dealt out over shards by it; other columns aren't read.
    """
    spark = docs.sparkSession
    ready(spark)
    uri = uri or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    files, folder = _filesystem(uri)
    files.create_dir(folder)
    width = 2 if vocabulary <= 1 << 16 else 4
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), text.alias("text")).withColumn("twin", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc", "twin").sortWithinPartitions("doc", "twin").select("doc", "text")
    shards = cut(rows.mapInArrow(tidy(_write(tokenizer, uri, width, end), True), SHARDS))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("part", F.lit(uri).alias("uri"), "name", "documents", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))


class TokenShard:
    """A shard on disk: doc_ids, offsets and ids, mapped into memory where the file system is a local one."""

    def __init__(self, uri: str, name: str):
        from pyarrow import fs

        files, _ = _filesystem(uri)
        if isinstance(files, fs.LocalFileSystem):
            head = np.memmap(f"{name}.idx", "<i8", "r")
            load = lambda dtype: np.memmap(f"{name}.bin", dtype, "r")
        else:
            head = np.frombuffer(files.open_input_file(f"{name}.idx").read(), "<i8")
            load = lambda dtype: np.frombuffer(files.open_input_file(f"{name}.bin").read(), dtype)
        magic, width, n = (int(x) for x in head[:3])
        if magic != MAGIC:
            raise ValueError(f"{name}.idx isn't a token index")
        self.doc_ids, self.offsets = head[3 : 3 + n], head[3 + n : 4 + 2 * n]
        self.ids = load(f"<u{width}") if self.offsets[-1] else np.zeros(0, f"<u{width}")

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = TokenShard(row["uri"], row["name"])
            n = len(shard.doc_ids)
            for i in range(0, n, 20_000):
                j = min(i + 20_000, n)
                crc = [zlib.crc32(shard[k].astype("<u4")) for k in range(i, j)]
                doc = np.asarray(shard.doc_ids[i:j])
                yield pa.record_batch([pa.array(doc, mask=doc == NULL_ID), pa.array(row["base"] + shard.offsets[i:j]), pa.array(np.diff(shard.offsets[i : j + 1])), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(shards: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start (ids before it), n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers)."""
    # a number of its own, so that adaptive execution doesn't join the few small rows, and with them all files, in one task
    shards = shards.select("part", "uri", "name", "base").repartition(max(1, shards.count()), "part")
    return shards.mapInArrow(tidy(_read), READ)
