"""TFRecord files of Examples as a data source and sink: framed records with checksums, compressed or not, a few to a file."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition

from ..session import ship
from .store import Job, Written, listed, place

#: Records of a file, as the training loaders expect; bytes read at once; records summed at once; bytes of files that are a
#: partition, and partitions that there are at least if files allow.
RECORDS, READ_BYTES, AT_ONCE, PART_BYTES, PARTS = 32, 1 << 20, 64, 8 << 20, 64
#: Fixed values of the format: the checksum's polynomial (reflected) and what its mask adds.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Bytes of a stretch that is summed beside others.
STRETCH = 256


def _table() -> np.ndarray:
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = np.where(rest & 1, rest >> 1 ^ POLYNOMIAL, rest >> 1).astype(np.uint32)
    return rest


TABLE = _table()
STEPS = TABLE.tolist()


def _stepped(state: np.ndarray, byte) -> np.ndarray:
    return TABLE[(state ^ byte) & 255] ^ state >> np.uint32(8)


@lru_cache(maxsize=1)
def _past_stretch() -> list[list[int]]:
    """For each byte of a state and each value what STRETCH zero bytes make of it; states add up by exclusive or."""
    state = np.array([[v << 8 * b for v in range(256)] for b in range(4)], np.uint32)
    for _ in range(STRETCH):
        state = _stepped(state, 0)
    return state.tolist()


def crc32c(data: bytes) -> int:
    return checksums([data])[0]


def checksums(all_: list[bytes]) -> list[int]:
    """The Castagnoli checksums of records; stretches of them all are summed side by side, then put together.

    Zero bytes before a record don't change a sum that begins at zero, and a beginning of ones turns its first four bytes over.
    """
    sums = [0] * len(all_)
    long = [i for i, x in enumerate(all_) if len(x) >= STRETCH // 8]
    if long:
        n = [-(-len(all_[i]) // STRETCH) for i in long]
        flat = np.zeros(sum(n) * STRETCH, np.uint8)
        end = 0
        for i, k in zip(long, n):
            end += k * STRETCH
            raw = flat[end - len(all_[i]) : end]
            raw[:] = np.frombuffer(all_[i], np.uint8)
            raw[:4] ^= 255
        columns = np.ascontiguousarray(flat.reshape(-1, STRETCH).T)
        state = np.zeros(columns.shape[1], np.uint32)
        for column in columns:
            state = _stepped(state, column)
        a, b, c, d = _past_stretch()
        parts, at = state.tolist(), 0
        for i, k in zip(long, n):
            s = 0
            for part in parts[at : at + k]:
                s = a[s & 255] ^ b[s >> 8 & 255] ^ c[s >> 16 & 255] ^ d[s >> 24] ^ part
            sums[i] = s ^ 0xFFFFFFFF
            at += k
    for i, data in enumerate(all_):
        if len(data) < STRETCH // 8:
            s = 0xFFFFFFFF
            for x in data:
                s = STEPS[(s ^ x) & 255] ^ s >> 8
            sums[i] = s ^ 0xFFFFFFFF
    return sums


def mask(c: int) -> int:
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def masked(data: bytes) -> int:
    return mask(crc32c(data))


def framed(record: bytes) -> bytes:
    return b"".join(frames([record]))


def frames(all_: list[bytes]) -> Iterator[bytes]:
    for record, c in zip(all_, checksums(all_)):
        size = struct.pack("<Q", len(record))
        yield b"".join((size, struct.pack("<I", masked(size)), record, struct.pack("<I", mask(c))))


def records(chunks: Iterator[bytes], name: str) -> Iterator[bytes]:
    """The records of a file's plain bytes; a record whose checksum differs, or that ends early, is an error."""
    held, n = b"", 0

    def upto(size: int) -> bool:
        nonlocal held
        parts, have = [held], len(held)
        while have < size and (more := next(chunks, b"")):
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        return have >= size

    some: list[tuple[bytes, int]] = []

    def checked() -> Iterator[bytes]:
        first = n - len(some)
        for i, ((record, told), c) in enumerate(zip(some, checksums([r for r, _ in some]))):
            if told != mask(c):
                raise ValueError(f"{name}: record {first + i} is damaged")
            yield record
        some.clear()

    at = size = 0
    while upto(at + 1):
        if not upto(at + 12) or struct.unpack("<I", held[at + 8 : at + 12])[0] != masked(held[at : at + 8]):
            yield from checked()
            raise ValueError(f"{name}: the head of record {n} is damaged")
        size = struct.unpack("<Q", held[at : at + 8])[0]
        if not upto(at + 16 + size):
            yield from checked()
            raise ValueError(f"{name}: record {n} is damaged")
        some.append((held[at + 12 : at + 12 + size], struct.unpack("<I", held[at + 12 + size : at + 16 + size])[0]))
        at, n = at + 16 + size, n + 1
        if at >= READ_BYTES or len(some) == AT_ONCE:
            yield from checked()
            held, at = held[at:], 0
    yield from checked()


def plain(path: str) -> Iterator[bytes]:
    """The bytes of a file in pieces, decompressed if it is a zlib or gzip stream."""
    system, at = place(path)
    with system.open_input_stream(at) as f:
        first = f.read(READ_BYTES)
        if len(first) >= 12 and struct.unpack("<I", first[8:12])[0] == masked(first[:8]):
            while first:
                yield first
                first = f.read(READ_BYTES)
            return
        open_ = zlib.decompressobj(47)
        try:
            while first:
                if made := open_.decompress(first):
                    yield made
                first = f.read(READ_BYTES)
            if made := open_.flush():
                yield made
        except zlib.error as e:
            raise ValueError(f"{path}: the stream is damaged") from e
        if not open_.eof:
            raise ValueError(f"{path}: the stream ends early")


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n, at, shift = n | (b & 127) << shift, at + 1, shift + 7
        if b < 128:
            return n, at


def messages(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a message's fields: bytes, or an integer."""
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = read_varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else read_varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def feature(value) -> bytes:
    """A Feature of bytes, text, floats or integers, single or in a list."""
    items = list(value) if isinstance(value, (list, tuple)) else [value]
    if all(isinstance(x, (bytes, bytearray, str)) for x in items):
        return field(1, b"".join(field(1, x.encode() if isinstance(x, str) else bytes(x)) for x in items))
    if any(isinstance(x, float) for x in items):
        return field(2, field(1, np.array(items, "<f4").tobytes()))
    return field(3, field(1, b"".join(varint(int(x)) for x in items)))


def example(row: dict) -> bytes:
    """A row as an Example; null columns are left out."""
    return field(1, b"".join(field(1, field(1, k.encode()) + field(2, feature(v))) for k, v in row.items() if v is not None))


def features(record: bytes) -> dict[str, list]:
    out = {}
    for _, all_ in messages(record):
        for _, entry in messages(all_):
            pair = dict(messages(entry))
            values: list = []
            for kind, data in messages(pair.get(2, b"")):
                for _, item in messages(data):
                    if kind == 1:
                        values.append(bytes(item))
                    elif kind == 2:
                        values += np.frombuffer(item, "<f4").tolist()
                    elif isinstance(item, int):
                        values.append(item - (1 << 64) if item >> 63 else item)
                    else:
                        at = 0
                        while at < len(item):
                            n, at = read_varint(item, at)
                            values.append(n - (1 << 64) if n >> 63 else n)
            out[pair[1].decode()] = values
    return out


def typed(values: list | None, kind: T.DataType):
    """A feature's values as a column's type: a list, or the first one."""
    if values is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [typed([v], kind.elementType) for v in values]
    if not values:
        return None
    v = values[0]
    return v.decode() if isinstance(kind, T.StringType) else float(v) if isinstance(kind, (T.FloatType, T.DoubleType)) else v


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TFRecordReader(DataSourceReader):
    """Files are read whole, as a compressed stream has no other places to begin at; many small ones are one partition."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> Sequence[InputPartition]:
        files = listed(self.path, (".tfr", ".tfrecord", ".tfrecords"))
        most = min(PART_BYTES, sum(n for _, n in files) / PARTS)
        parts, room = [], 0.0
        for path, n in files:
            if not parts or n > room:
                parts.append([])
                room = most
            parts[-1].append(path)
            room -= n
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[tuple]:
        kinds = [(f.name, f.dataType) for f in self.schema.fields]
        for path in partition.paths:
            for record in records(plain(path), path):
                own = features(record)
                yield tuple(typed(own.get(name), kind) for name, kind in kinds)


class TFRecordWriter(DataSourceWriter):
    def __init__(self, job: Job, label: str, count: int, compressed: bool):
        self.job, self.label, self.count, self.compressed = job, label, count, compressed

    def write(self, iterator: Iterator[Row]) -> Written:
        task = TaskContext.get()
        names, held, rows = [], [], 0

        def close() -> None:
            names.append(f"{self.label}-{task.partitionId():05d}-{len(names):05d}-{self.job.id}-{task.taskAttemptId()}.tfr")
            data = b"".join(frames(held))
            with self.job.open(names[-1]) as out:
                out.write(zlib.compress(data) if self.compressed else data)
            held.clear()

        for row in iterator:
            held.append(example(row.asDict()))
            rows += 1
            if len(held) == self.count:
                close()
        if held:
            close()
        return Written(tuple(names), rows)

    def commit(self, messages) -> None:
        self.job.commit(messages)

    def abort(self, messages) -> None:
        self.job.clear()


class TFRecord(DataSource):
    """format("tfrecord"). Options: label (of file names), records (of a file), compression (ZLIB or none).

    Without a schema, that of the first record: bytes as binary, numbers as arrays.
    """

    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> T.StructType:
        path, _ = listed(self.options["path"], (".tfr", ".tfrecord", ".tfrecords"))[0]
        first = features(next(records(plain(path), path)))
        kind = lambda v: T.BinaryType() if v and isinstance(v[0], bytes) else T.ArrayType(T.FloatType() if v and isinstance(v[0], float) else T.LongType())
        return T.StructType([T.StructField(k, kind(v)) for k, v in sorted(first.items())])

    def reader(self, schema: T.StructType) -> TFRecordReader:
        return TFRecordReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> TFRecordWriter:
        o = self.options
        return TFRecordWriter(Job(o["path"], overwrite, ".tfr"), o.get("label", "part"), int(o.get("records", RECORDS)), o.get("compression", "ZLIB").upper() == "ZLIB")


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(TFRecord)


def write_tfrecords(df: DataFrame, path: str, label: str = "train", count: int = RECORDS, mode: str = "append") -> None:
    """df's rows as Examples, `count` to a file (K5): bytes, text, numbers and lists of them; all files appear, or none."""
    register(df.sparkSession)
    df.write.format("tfrecord").option("label", label).option("records", count).mode(mode).save(path)


def read_tfrecords(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Rows of Examples (S18); a damaged record is an error that names its file."""
    register(spark)
    reader = spark.read.format("tfrecord")
    return (reader.schema(schema) if schema else reader).load(path)
