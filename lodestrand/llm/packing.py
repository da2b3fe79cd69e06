"""Best-fit packing, planned over a histogram of lengths; documents take the planned slots by their rank within their length."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, cut, few_rows, ready, release, text_bytes, tidy
from .tokens import encoder

#: Bytes of texts that are encoded at once (a longer text alone): the more, the fewer distinct stretches are looked up. Bytes of ids that go out at once.
ENCODED_BYTES, IDS_BYTES = 4 << 20, 4 << 20


def plan(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first sequence, places in each sequence, offset of the first place).

    Best-fit decreasing over counts: for each length from the largest, the sequences with the least sufficient space
    take as many pieces as fit, all sequences of one kind at once. Kinds, not sequences or documents, are held, so the
    plan's size depends on the number of lengths only. Rank r of a slot goes to sequence first + (r - first rank) // places.
    """
    kinds: dict[int, list[tuple[int, int]]] = {}  # space left: [(first sequence, number)]
    spaces: list[int] = []
    slots, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= room:
            raise ValueError(f"a piece of {length} tokens doesn't fit {room}")
        waiting = sorted(s for s in kinds if s >= length and kinds[s])
        heapq.heapify(waiting)
        while left:
            while waiting and not kinds.get(waiting[0]):
                heapq.heappop(waiting)
            if waiting:
                space = waiting[0]
                first, number = kinds[space].pop()
            else:
                space, first, number = room, sequences, -(-left // (room // length))
                sequences += number
            each = space // length
            full, rest = divmod(min(left, each * number), each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, room - space))
                rank += full * each
                kinds.setdefault(space - each * length, []).append((first, full))
            used = full
            if rest:
                slots.append((length, rank, rank + rest, first + full, rest, room - space))
                rank += rest
                kinds.setdefault(space - rest * length, []).append((first + full, 1))
                used += 1
            if used < number:
                kinds.setdefault(space, []).append((first + used, number - used))
            left = counts[length] - rank
        kinds = {s: v for s, v in kinds.items() if v and s}
    return slots


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def _pieces(path: str, room: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks = TaskContext.get().partitionId(), np.zeros(room + 1, np.int64)
        codec = encoder("bytes", path, 4)
        tail = np.array([end], "<u4").tobytes()
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            names, texts = batch.column("doc_id"), batch.column("text")
            for i, j in blocks(text_bytes(texts)[1], ENCODED_BYTES):
                ids = names.slice(i, j - i).to_pylist()
                rows = []
                for doc, made in zip(ids, codec.encode([t or "" for t in texts.slice(i, j - i).to_pylist()])):
                    made += tail
                    n, at, piece = len(made) // 4, 0, 0
                    while at < n:
                        size = (n - at) % room or room
                        own = made[4 * at : 4 * (at + size)]
                        rows.append((doc, piece, at, size, zlib.crc32(own), part, int(ranks[size]), *([pack(own)] if with_ids else [])))
                        ranks[size] += 1
                        at, piece = at + size, piece + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                columns = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local", "z"][: 7 + with_ids]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=columns)
                del ids, rows, made
                release()

    return run


def _with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, z, becomes ids; at most IDS_BYTES of them, or one row, go out at once."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        ends = 4 * np.cumsum(batch.column("length").to_numpy())
        for i, j in blocks(np.concatenate(([0], ends)), IDS_BYTES):
            part = batch.slice(i, j - i)
            ids = pa.array([unpack(z) for z in part.column("z").to_pylist()], pa.binary())
            yield pa.record_batch([*part.columns[:-1], ids], names=[*part.schema.names[:-1], "ids"])


def token_pieces(docs: DataFrame, tokenizer: str, room: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text): ids of the text and the end id, cut into `room` ids if there are more; the first piece is the short one.

    part and local rank a piece among those of its length in its task. A null text is empty (one end id). with_ids: z has the
    piece's ids, little-endian unsigned 32-bit, as zstd for the way. Workers keep no encoder from task to task: with large
    blocks a task's own words suffice, and encoders would stay in memory while later stages run.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(tidy(_pieces(tokenizer, room, end, with_ids)), PIECES + ", z binary" * with_ids)


def best_fit_pack(docs: DataFrame, tokenizer: str, room: int = 1024, end: int = 2, with_ids: bool = True) -> DataFrame:
    """Every piece of docs(doc_id, text) with its sequence_id and offset there; with_ids: and its ids, little-endian unsigned 32-bit.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Sequences hold `room` ids at most, without
    gaps. Repeated rows are packed each, a null doc_id stays null, other columns of docs aren't read, an empty table
    gives an empty result. Only the histogram, `room` counts, reaches the driver, and the plan, a few slots for each
    length, goes back. Ranks come from sums over (length, task), so no length is gathered in one task.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, tokenizer, room, end, with_ids))
    sums = cut(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    slots = few_rows(spark, plan(counts, room), "length long, low long, high long, first long, places long, at long")
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local"))
    placed = ranked.join(F.broadcast(slots), "length").where("rank >= low AND rank < high")  # the plan's size is bound by `room`
    out = placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("places"))).alias("sequence_id"),
        (F.col("at") + F.pmod(F.col("rank") - F.col("low"), F.col("places")) * F.col("length")).alias("offset"), *(["z"] if with_ids else []),
    )
    return out.mapInArrow(tidy(_with_ids), PLACED) if with_ids else out
