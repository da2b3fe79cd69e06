"""NumPy archives as a data source and sink: one array is read by many tasks, by ranges of its rows."""

from __future__ import annotations

import io
import math
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from ..session import ship
from .store import Job, Written, listed, place

SCHEMA = "member string, row long, shape array<long>, values array<double>"
#: Bytes of an array that one task reads, and that are decoded at once; a member of an archive with this ending says which row is its first.
PARTITION_BYTES, DECODED_BYTES, FIRST = 1 << 24, 1 << 20, ".first_row"


class Rows(InputPartition):
    """Rows [low, high) of one array."""

    def __init__(self, path: str, member: str, low: int, high: int, first: int):
        self.path, self.member, self.low, self.high, self.first = path, member, low, high, first


class _File(io.RawIOBase):
    """An Arrow file for the zip reader."""

    def __init__(self, path: str):
        system, at = place(path)
        self.file, self.at = system.open_input_file(at), 0
        self.end = self.file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (0, self.at, self.end)[whence]
        return self.at

    def readinto(self, into) -> int:
        data = self.file.read_at(min(len(into), max(0, self.end - self.at)), self.at)
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


def archive(path: str) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BufferedReader(_File(path), 1 << 16))


def head(f) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """(shape, order by columns, type, bytes of the header) of an open .npy member."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(f)
    if kind.hasobject or kind.fields:
        raise ValueError("only plain numbers are read")
    return shape, fortran and len(shape) > 1, kind, f.tell()


class NpzReader(DataSourceReader):
    def __init__(self, path: str, members: str | None):
        self.path, self.members = path, set(members.split(",")) if members else None

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of rows; a deflated array has one, which streams through it, as has one kept by columns."""
        out = []
        for path, _ in listed(self.path, (".npz",)):
            with archive(path) as z:
                firsts = {i.filename[: -len(FIRST + ".npy")]: int(np.load(io.BytesIO(z.read(i)))) for i in z.infolist() if i.filename.endswith(FIRST + ".npy")}
                for i in z.infolist():
                    name = i.filename.removesuffix(".npy")
                    if name.endswith(FIRST) or self.members is not None and name not in self.members:
                        continue
                    with z.open(i) as f:
                        shape, fortran, kind, _ = head(f)
                    rows = shape[0] if shape else 1
                    step = rows if i.compress_type != zipfile.ZIP_STORED or fortran else max(1, PARTITION_BYTES // max(1, kind.itemsize * math.prod(shape[1:])))
                    out += [Rows(path, i.filename, a, min(rows, a + step), firsts.get(name, 0)) for a in range(0, rows, max(1, step))]
        return out or [Rows("", "", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.low == p.high:
            return
        with archive(p.path) as z, z.open(p.member) as f:
            shape, fortran, kind, at = head(f)
            inner = shape[1:]
            width = math.prod(inner)
            if fortran:  # its rows lie apart: the array is read whole
                whole = np.frombuffer(f.read(), kind).reshape(shape, order="F")
                blocks = iter([whole.reshape(len(whole), width)])
            else:
                f.seek(at + p.low * width * kind.itemsize)
                step = max(1, DECODED_BYTES // max(1, width * kind.itemsize))
                blocks = (np.frombuffer(f.read((min(p.high, r + step) - r) * width * kind.itemsize), kind).reshape(-1, width) for r in range(p.low, p.high, step))
            row, name = p.first + p.low, p.member.removesuffix(".npy")
            for block in blocks:
                values = block.astype(np.float64)
                if kind.kind in "iu" and kind.itemsize == 8 and (values.astype(kind) != block).any():
                    raise ValueError(f"{p.path}: {name} holds integers beyond 53 bits")
                n = len(values)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
                yield pa.record_batch(
                    [pa.array([name] * n, pa.string()), pa.array(np.arange(row, row + n)), pa.array([list(inner)] * n, pa.list_(pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))],
                    names=["member", "row", "shape", "values"],
                )
                row += n


class NpzWriter(DataSourceArrowWriter):
    """An archive for each task, with a run of rows of each member that it has; rows come by member and row."""

    def __init__(self, job: Job, kind: str):
        self.job, self.kind = job, kind

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        held: dict[str, tuple[int, list[int], list[np.ndarray]]] = {}
        rows = 0
        for batch in iterator:
            for member, row, shape, values in zip(*(batch.column(c).to_pylist() for c in ("member", "row", "shape", "values"))):
                first, inner, all_ = held.setdefault(member, (row, shape, []))
                if row != first + len(all_):
                    raise ValueError(f"{member}: row {row} doesn't follow on {first + len(all_) - 1}")
                if shape != inner or len(values) != math.prod(inner):
                    raise ValueError(f"{member}: row {row} has another shape")
                all_.append(np.array(values, self.kind))
                rows += 1
        if not held:
            return Written(())
        name = f"part-{task.partitionId():05d}-{self.job.id}-{task.taskAttemptId()}.npz"
        with self.job.open(name) as out:
            data = io.BytesIO()
            np.savez(data, **{m: np.stack(all_).reshape(len(all_), *inner) for m, (_, inner, all_) in held.items()}, **{m + FIRST: np.int64(first) for m, (first, _, _) in held.items()})
            out.write(data.getbuffer())
        return Written((name,), rows)

    def commit(self, messages) -> None:
        self.job.commit(messages)

    def abort(self, messages) -> None:
        self.job.clear()


class Npz(DataSource):
    """format("npz"): a row for each row of each array; shape is that of one row. Options: members, to read; dtype, to write."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options["path"], self.options.get("members"))

    def writer(self, schema, overwrite: bool) -> NpzWriter:
        return NpzWriter(Job(self.options["path"], overwrite, ".npz"), self.options.get("dtype", "float32"))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Npz)


def write_npz(rows: DataFrame, path: str, dtype: str = "float32", mode: str = "append") -> None:
    """rows(member, row, shape, values) as archives, a range of rows in each (K6); all appear, or none."""
    register(rows.sparkSession)
    rows = rows.select(F.col("member").cast("string"), F.col("row").cast("long"), F.col("shape").cast("array<long>"), F.col("values").cast("array<double>"))
    rows.repartitionByRange("member", "row").sortWithinPartitions("member", "row").write.format("npz").option("dtype", dtype).mode(mode).save(path)


def read_npz(spark: SparkSession, path: str, members: str | None = None) -> DataFrame:
    """(member, row, shape, values) of an archive or a folder of them."""
    register(spark)
    reader = spark.read.format("npz")
    return (reader.option("members", members) if members else reader).load(path)
