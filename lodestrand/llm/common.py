"""What the operators share: cutting lineage, Arrow text buffers, word hashes."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import tokens

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Text bytes that one numpy block holds at most (a longer document has a block of its own).
BLOCK_BYTES = 1 << 20

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes that end a word: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ready(spark: SparkSession) -> None:
    """Executors import this package: hand its folder to their Python path."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{REPO}:{env.get('PYTHONPATH', '')}".rstrip(":")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own on a single machine (tests)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file:///tmp/checkpoints/{os.getpid()}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder now and go on from there; the files go when the result is garbage."""
    shared_dir(df.sparkSession)
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that one task deals with in less time than a shuffle takes (a few megabytes of narrow rows).
FEW = 200_000


def gathered(df: DataFrame) -> DataFrame:
    """df cut, in one partition if it has FEW rows or less, so that what follows on it needs no shuffle; more rows stay spread."""
    df = cut(df)
    return df.coalesce(1) if df.count() <= FEW else df


def few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of a few rows of string, int and long columns, sent as Arrow: pickled rows would have Python workers of their own on each executor."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields))


def release() -> None:
    """What this process freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], remembers: bool = False):
    """run for mapInArrow; at a task's end what it freed goes back to the system, as workers outlive tasks and stages.

    remembers: the task goes on with the words that earlier ones in its worker encoded; others forget them first, and
    their own at the end: tasks go to the worker that was idle longest, so each of them would come to hold an encoder.
    """

    def then_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remembers:
            tokens.encoder.cache_clear()
        yield from run(batches)
        if not remembers:
            tokens.encoder.cache_clear()
        release()

    return then_release


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def packed(df: DataFrame, column: str = "text") -> DataFrame:
    """df with a text column compressed to the binary column z, for a shuffle; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = batch.column(column)
            data, at = text_bytes(texts)
            known = texts.is_valid().to_pylist()
            z = pa.array([pack(data[at[i] : at[i + 1]]) if known[i] else None for i in range(len(known))], pa.binary())
            yield pa.record_batch([*(batch.column(c) for c in others), z], names=[*others, "z"])

    others = [c for c in df.columns if c != column]
    return df.mapInArrow(tidy(run), T.StructType([*(df.schema[c] for c in others), T.StructField("z", T.BinaryType())]))


def unpacked(column: pa.Array) -> pa.Array:
    """The texts of a column z, as a string column."""
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([None if z is None else unpack(z) for z in column.to_pylist()], pa.binary()).cast(pa.string())


#: Bytes of texts that are unpacked at once (a longer document alone).
OPENED_BYTES = 8 << 20


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batches in parts whose column z holds at most OPENED_BYTES of text, or one row, each with its texts."""
    for batch in batches:
        size = [0 if z is None else zstandard.frame_content_size(z) for z in batch.column("z").to_pylist()]
        for i, j in blocks(np.concatenate(([0], np.cumsum(size, dtype=np.int64))), OPENED_BYTES):
            part = batch.slice(i, j - i)
            yield part, unpacked(part.column("z"))


def blocks(at: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the result."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            for name, base in (("up", BASE), ("down", INVERSE)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(cls, name, np.cumprod(table))
        return cls.up, cls.down


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums S with which (S[e] - S[s]) * down[s] is a hash of data[s:e]."""
    up, _ = Powers.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * up[: len(data)], out=sums[1:])
    return sums


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of rows data[at[i]:at[i+1]], ASCII letters folded; and the n + 1 word offsets of the rows."""
    low, high = int(at[0]), int(at[-1])
    rows = len(at) - 1
    joined = np.full(high - low + rows, 32, np.uint8)
    starts = at[:-1] - low + np.arange(rows)
    for i in range(rows):
        joined[starts[i] : starts[i] + at[i + 1] - at[i]] = data[at[i] : at[i + 1]]
    space = SPACE[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    begin, end = edge[::2], edge[1::2]
    sums = prefix_hash(LOWER[joined])
    _, down = Powers.to(len(joined) + 1)
    words = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    return words, np.append(np.searchsorted(begin, starts), len(begin))


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its `width`-word shingles; with fewer words, of the whole sequence."""
    words, where = word_hashes(data, at)
    n = len(words)
    grams = np.zeros(0, np.uint64)
    if n >= width:
        grams = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            grams = mix(grams * U(0xFF51AFD7ED558CCD) + words[k : n - width + 1 + k])
    out = []
    for i in range(len(where) - 1):
        a, b = int(where[i]), int(where[i + 1])
        if b - a >= width:
            s = np.sort(grams[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = mix(h * U(0xC4CEB9FE1A85EC53) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
