"""HDF5 files as a data source and sink: the datasets of a group are the columns of rows, ranges of rows are tasks.

Read is what libraries write by default: superblock 0 or 1, symbol-table groups, version 1 object headers, and compact,
contiguous or chunked datasets of numbers and fixed strings, chunks deflated, shuffled or summed. Anything else (later
superblocks, strings of variable length, external files) raises an error that names it; nothing is passed over.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from .store import Job, Written, listed, place

SIGNATURE, NONE = b"\x89HDF\r\n\x1a\n", (1 << 64) - 1
DATASPACE, DATATYPE, FILL, LAYOUT, FILTERS, MORE, GROUP = 1, 3, 5, 8, 11, 16, 17
DEFLATE, SHUFFLE, FLETCHER = 1, 2, 3
#: Bytes of rows that one task reads, and that are decoded at once.
PARTITION_BYTES, DECODED_BYTES = 1 << 24, 1 << 20
#: Bytes of rows from which a task closes a file and begins the next one; rows of a chunk; children of a tree's node.
FILE_BYTES, CHUNK_ROWS, FANOUT = 1 << 24, 1024, 64
OWN = ("file", "member", "row")


@dataclass
class Dataset:
    """Where a dataset's rows lie."""

    shape: tuple[int, ...]
    kind: np.dtype
    layout: int  # 0 compact, 1 contiguous, 2 chunked
    at: int = 0
    chunk: tuple[int, ...] = ()
    filters: tuple[tuple[int, tuple[int, ...]], ...] = ()
    held: bytes = b""
    fill: bytes = b""

    @property
    def row_bytes(self) -> int:
        return self.kind.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))


class File:
    """The parts of one file that are asked for; read counts the bytes."""

    def __init__(self, path: str):
        system, at = place(path)
        self.path, self.file, self.read = path, system.open_input_file(at), 0
        head = self.bytes(0, 96)
        if head[:8] != SIGNATURE or head[8] > 1 or head[13:15] != b"\x08\x08":
            raise ValueError(f"{path}: not an HDF5 file with superblock 0 or 1 and addresses of 8 bytes")
        entry = 56 + 4 * head[8]
        self.base, (self.root,) = struct.unpack_from("<Q", head, entry - 32)[0], struct.unpack_from("<Q", head, entry + 8)

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def bytes(self, at: int, n: int) -> bytes:
        self.read += n
        data = self.file.read_at(n, at + getattr(self, "base", 0))
        if len(data) < n and at:
            raise ValueError(f"{self.path}: ends before byte {at + n}")
        return data

    def messages(self, at: int) -> dict[int, bytes]:
        """The messages of an object header, by type."""
        version, _, count, _, size = struct.unpack("<BBHII", self.bytes(at, 12))
        if version != 1:
            raise ValueError(f"{self.path}: object headers of version {version} aren't read")
        out, parts = {}, [(at + 16, size)]
        for begin, length in parts:  # grows by continuations
            data, p = self.bytes(begin, length), 0
            while p + 8 <= length and count:
                kind, n, flags = struct.unpack_from("<HHB", data, p)
                body = data[p + 8 : p + 8 + n]
                if flags & 2 and kind in (DATASPACE, DATATYPE, FILL, LAYOUT, FILTERS):
                    raise ValueError(f"{self.path}: shared messages aren't read")
                if kind == MORE:
                    parts.append(struct.unpack("<QQ", body[:16]))
                out.setdefault(kind, body)
                p, count = p + 8 + n, count - 1
        return out

    def leaves(self, at: int, kind: int, key: int, low: int = 0, high: int = NONE) -> Iterator[tuple[bytes, int]]:
        """(key, address) of what a tree's leaves hold; of chunks only those whose first row may lie before high and whose next key begins after low."""
        head = self.bytes(at, 24)
        if head[:4] != b"TREE" or head[4] != kind:
            raise ValueError(f"{self.path}: no tree at byte {at}")
        level, n = head[5], struct.unpack_from("<H", head, 6)[0]
        data = self.bytes(at + 24, n * (key + 8) + key)
        keys = [data[i * (key + 8) : i * (key + 8) + key] for i in range(n + 1)]
        for i in range(n):
            child = struct.unpack_from("<Q", data, i * (key + 8) + key)[0]
            if kind == 1:
                first, after = (struct.unpack_from("<Q", k, 8)[0] for k in keys[i : i + 2])
                if first >= high or level and after < low:
                    continue
            if level:
                yield from self.leaves(child, kind, key, low, high)
            else:
                yield keys[i], child

    def members(self, table: bytes) -> Iterator[tuple[str, int]]:
        """(name, header) of a group's members."""
        tree, heap = struct.unpack("<QQ", table[:16])
        size, _, names = struct.unpack("<QQQ", self.bytes(heap + 8, 24))
        text = self.bytes(names, size)
        for _, at in self.leaves(tree, 0, 8):
            count = struct.unpack("<H", self.bytes(at + 6, 2))[0]
            data = self.bytes(at + 8, 40 * count)
            for i in range(count):
                name, header, cache = struct.unpack_from("<QQI", data, 40 * i)
                if cache == 2:
                    raise ValueError(f"{self.path}: symbolic links aren't read")
                yield text[name : text.index(b"\0", name)].decode(), header

    def groups(self, own: set[str] | None, at: int | None = None, path: str = "") -> Iterator[tuple[str, dict[str, dict[int, bytes]]]]:
        """(path, the datasets' messages by name) of each group with datasets; own: the paths that are asked for, if not all."""
        datasets, inner = {}, []
        for name, header in self.members(self.messages(self.root if at is None else at)[GROUP]):
            found = self.messages(header)
            below = f"{path}/{name}".lstrip("/")
            if GROUP not in found:
                datasets[name] = found
            elif own is None or any(x == below or x.startswith(below + "/") for x in own):
                inner.append((below, header))
        if datasets and (own is None or path in own):
            yield path, datasets
        for below, header in inner:
            yield from self.groups(own, header, below)

    def dataset(self, found: dict[int, bytes]) -> Dataset:
        space = found[DATASPACE]
        rank = space[1]
        shape = struct.unpack_from(f"<{rank}Q", space, 8 if space[0] == 1 else 4)
        out = Dataset(shape or (1,), self.kind(found[DATATYPE]), found[LAYOUT][1])
        layout = found[LAYOUT]
        if layout[0] != 3:
            raise ValueError(f"{self.path}: layouts of version {layout[0]} aren't read")
        if out.layout == 0:
            out.held = layout[4 : 4 + struct.unpack_from("<H", layout, 2)[0]]
        elif out.layout == 1:
            out.at = struct.unpack_from("<Q", layout, 2)[0]
        else:
            n = layout[2]
            out.at, out.chunk = struct.unpack_from("<Q", layout, 3)[0], struct.unpack_from(f"<{n - 1}I", layout, 11)
        fill = found.get(FILL, b"")
        if fill and (fill[0] < 3 and fill[3] or fill[0] == 3 and fill[1] & 32):
            p = 4 if fill[0] < 3 else 2
            out.fill = fill[p + 4 : p + 4 + struct.unpack_from("<I", fill, p)[0]]
        out.filters = tuple(self.filters(found.get(FILTERS, b"")))
        return out

    def kind(self, data: bytes) -> np.dtype:
        what, order, (size,) = data[0] & 15, "<>"[data[1] & 1], struct.unpack_from("<I", data, 4)
        if what == 0:
            return np.dtype(f"{order}{'i' if data[1] & 8 else 'u'}{size}")
        if what == 1 and size in (2, 4, 8):
            return np.dtype(f"{order}f{size}")
        if what == 3:
            return np.dtype(f"S{size}")
        if what == 8:  # an enumeration, as truth values are kept: its numbers
            return self.kind(data[8:])
        raise ValueError(f"{self.path}: datatypes of class {what} and {size} bytes aren't read")

    def filters(self, data: bytes) -> Iterator[tuple[int, tuple[int, ...]]]:
        p = 8 if data[:1] == b"\1" else 2
        for _ in range(data[1] if data else 0):
            number, length = struct.unpack_from("<HH", data, p)
            if data[0] == 2 and number < 256:
                length, p = 0, p - 2
            _, n = struct.unpack_from("<HH", data, p + 4)
            if number not in (DEFLATE, SHUFFLE, FLETCHER):
                raise ValueError(f"{self.path}: filter {number} isn't read")
            p += 8 + (length + 7 & ~7 if data[0] == 1 else length)
            yield number, struct.unpack_from(f"<{n}I", data, p)
            p += 4 * (n + n % 2 if data[0] == 1 else n)

    def rows(self, d: Dataset, low: int, high: int) -> np.ndarray:
        """Rows [low, high), each flat; only chunks with such rows are read."""
        inner = d.shape[1:]
        width = int(np.prod(inner, dtype=np.int64))
        if d.layout == 0:
            return np.frombuffer(d.held, d.kind)[: int(np.prod(d.shape))].reshape(-1, width)[low:high]
        out = np.zeros((high - low, *inner), d.kind)
        if d.fill:
            out[...] = np.frombuffer(d.fill, d.kind)[0]
        if d.at == NONE or not out.size:
            return out.reshape(high - low, width)
        if d.layout == 1:
            return np.frombuffer(self.bytes(d.at + low * d.row_bytes, (high - low) * d.row_bytes), d.kind).reshape(high - low, width)
        rank = len(d.shape)
        for key, at in self.leaves(d.at, 1, 16 + 8 * rank, max(0, low - d.chunk[0] + 1), high):
            size, mask, *offset = struct.unpack(f"<II{rank + 1}Q", key)
            if offset[0] + d.chunk[0] <= low or offset[0] >= high:
                continue
            raw = self.bytes(at, size)
            for i, (number, values) in reversed(list(enumerate(d.filters))):
                if mask >> i & 1:
                    continue
                if number == DEFLATE:
                    raw = zlib.decompress(raw)
                elif number == FLETCHER:
                    raw = raw[:-4]
                else:
                    size = values[0]
                    whole = len(raw) // size * size
                    raw = np.frombuffer(raw[:whole], np.uint8).reshape(size, -1).T.tobytes() + raw[whole:]
            block = np.frombuffer(raw, d.kind).reshape(d.chunk)
            a, b = max(low, offset[0]), min(high, offset[0] + d.chunk[0])
            ends = [min(s, o + c) for s, o, c in zip(inner, offset[1:], d.chunk[1:])]
            out[(slice(a - low, b - low), *(slice(o, e) for o, e in zip(offset[1:], ends)))] = block[(slice(a - offset[0], b - offset[0]), *(slice(0, e - o) for o, e in zip(offset[1:], ends)))]
        return out.reshape(high - low, width)


@dataclass
class Rows(InputPartition):
    """Rows [low, high) of a group's datasets."""

    path: str
    member: str
    datasets: dict[str, Dataset] = field(default_factory=dict)
    low: int = 0
    high: int = 0


class Hdf5Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema
        self.columns = [f.name for f in schema if f.name not in OWN]
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and IN choose groups (by member) and rows (by a column); Spark still applies every filter to the rows."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1:
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], own) & own
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of rows of each group that has all columns as datasets."""
        out = []
        for path, _ in listed(self.path, (".h5", ".hdf5")):
            with File(path) as f:
                for member, found in f.groups(self.wanted.get("member")):
                    if not self.columns or not set(self.columns) <= set(found):
                        continue
                    own = {c: f.dataset(found[c]) for c in self.columns}
                    if len({d.shape[0] for d in own.values()}) > 1:
                        raise ValueError(f"{path}: datasets of {member or '/'} have different numbers of rows")
                    rows, most = own[self.columns[0]].shape[0], max(d.chunk[0] if d.chunk else 1 for d in own.values())
                    step = max(1, PARTITION_BYTES // max(1, sum(d.row_bytes for d in own.values())) // most) * most
                    out += [Rows(path, member, own, a, min(rows, a + step)) for a in range(0, rows, step)]
        return out or [Rows("", "")]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.low == p.high:
            return
        types = to_arrow_schema(self.schema)
        most = max(d.chunk[0] if d.chunk else 1 for d in p.datasets.values())
        step = max(1, DECODED_BYTES // max(1, sum(d.row_bytes for d in p.datasets.values())) // most) * most
        tested = [c for c in self.columns if c in self.wanted]
        with File(p.path) as f:
            for low in range(p.low, p.high, step):
                high = min(p.high, low + step)
                have, keep = {}, np.ones(high - low, bool)
                for c in [*tested, *(c for c in self.columns if c not in tested)]:
                    if not keep.any():
                        break
                    have[c] = column(f.rows(p.datasets[c], low, high), types.field(c).type)
                    if c in tested:
                        keep &= np.isin(np.array(have[c].to_pylist(), object), list(self.wanted[c]))
                if not keep.any():
                    continue
                n = high - low
                own = {"file": lambda: pa.array([p.path] * n), "member": lambda: pa.array([p.member] * n), "row": lambda: pa.array(np.arange(low, high))}
                columns = [have[c] if c in have else own[c]().cast(types.field(c).type) for c in self.schema.names]
                yield pa.record_batch(columns, schema=types).filter(pa.array(keep))


def column(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a dataset as an Arrow column; strings end at their padding."""
    if rows.dtype.kind == "S":
        flat = pa.array([x.rstrip(b" \0") for x in rows.ravel().tolist()], pa.binary()).cast(pa.string())
    else:
        flat = pa.array(rows.ravel().astype(rows.dtype.newbyteorder("=")))
    if pa.types.is_list(kind):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat.cast(kind.value_type), type=kind)
    if rows.shape[1] != 1:
        raise ValueError("a dataset of more than one dimension is an array column")
    return flat.cast(kind)


class Out:
    """A file in memory: parts are appended, and each tells its address; the superblock comes last."""

    def __init__(self):
        self.data = bytearray(96)

    def add(self, part: bytes) -> int:
        at = len(self.data)
        self.data += part + b"\0" * (-len(part) % 8)
        return at

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHB3x", kind, len(m) + -len(m) % 8, 0) + m + b"\0" * (-len(m) % 8) for kind, m in messages)
        return self.add(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def node(self, kind: int, level: int, keys: list[bytes], children: list[int], room: int) -> int:
        body = b"".join(k + struct.pack("<Q", c) for k, c in zip(keys, children)) + keys[-1]
        return self.add(b"TREE" + struct.pack("<BBHQQ", kind, level, len(children), NONE, NONE) + body.ljust(room * (len(keys[0]) + 8) + len(keys[0]), b"\0"))

    def dataset(self, values: np.ndarray) -> int:
        """Chunks of CHUNK_ROWS rows, shuffled and deflated, under a tree."""
        kind, rank = values.dtype, values.ndim
        if kind.kind == "S":
            datatype = struct.pack("<BBBBI", 0x13, 1, 0, 0, kind.itemsize)
        elif kind.kind == "f":  # sign, exponent and mantissa of 64-bit numbers
            datatype = struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 63, 0, 8, 0, 64, 52, 11, 0, 52, 1023)
        else:
            datatype = struct.pack("<BBBBIHH", 0x10, 8, 0, 0, 8, 0, 64)
        chunk = (CHUNK_ROWS, *(max(1, s) for s in values.shape[1:]))
        keys, places = [], []
        for low in range(0, len(values) if values.size else 0, CHUNK_ROWS):
            block = np.zeros(chunk, kind)
            part = values[low : low + CHUNK_ROWS]
            block[: len(part)] = part
            raw = zlib.compress(np.frombuffer(block.tobytes(), np.uint8).reshape(-1, kind.itemsize).T.tobytes(), 1)
            keys.append(struct.pack(f"<II{rank + 1}Q", len(raw), 0, low, *[0] * rank))
            places.append(self.add(raw))
        end, level = struct.pack(f"<II{rank + 1}Q", 0, 0, -(-len(values) // CHUNK_ROWS) * CHUNK_ROWS, *[0] * rank), 0
        while len(places) > 1 or places and not level:
            cuts = range(0, len(places), FANOUT)
            nodes = [self.node(1, level, [*keys[i : i + FANOUT], (keys[i + FANOUT :] or [end])[0]], places[i : i + FANOUT], FANOUT) for i in cuts]
            keys, places, level = [keys[i] for i in cuts], nodes, level + 1
        filters = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHI4x", SHUFFLE, 0, 1, 1, kind.itemsize) + struct.pack("<HHHHI4x", DEFLATE, 0, 1, 1, 1)
        return self.header([
            (DATASPACE, struct.pack(f"<BBBx4x{rank}Q", 1, rank, 0, *values.shape)), (DATATYPE, datatype), (FILL, struct.pack("<BBBB", 2, 3, 0, 0)),
            (LAYOUT, struct.pack(f"<BBBQ{rank + 1}I", 3, 2, rank + 1, places[0] if places else NONE, *chunk, kind.itemsize)), (FILTERS, filters),
        ])

    def group(self, entries: dict[str, int | tuple[int, int, int]], leaf: int) -> tuple[int, int, int]:
        """(header, tree, heap) of a group of datasets (header) and groups, in order of names."""
        text, places = bytearray(8), {}
        for name in sorted(entries, key=str.encode):
            places[name] = len(text)
            text += name.encode() + b"\0"
            text += b"\0" * (-len(text) % 8)
        names = self.add(bytes(text))
        heap = self.add(b"HEAP" + struct.pack("<B3xQQQ", 0, len(text), 1, names))
        rows = b"".join(struct.pack("<QQI4xQQ", at, *((e, 0, 0, 0) if isinstance(e := entries[name], int) else (e[0], 1, *e[1:]))) for name, at in places.items())
        table = self.add(b"SNOD" + struct.pack("<BxH", 1, len(entries)) + rows.ljust(2 * leaf * 40, b"\0"))
        tree = self.node(0, 0, [struct.pack("<Q", k) for k in (0, max(places.values()))], [table], 32)
        return self.header([(GROUP, struct.pack("<QQ", tree, heap))]), tree, heap

    def tree(self, datasets: dict[str, np.ndarray]) -> bytes:
        """The file of datasets by path."""
        nested: dict = {}
        for path, values in datasets.items():
            *folders, name = path.split("/")
            at = nested
            for x in folders:
                at = at.setdefault(x, {})
            at[name] = values

        def widest(x: dict) -> int:
            return max([len(x), *(widest(y) for y in x.values() if isinstance(y, dict))])

        def made(x: dict) -> tuple[int, int, int]:
            return self.group({k: made(y) if isinstance(y, dict) else self.dataset(y) for k, y in x.items()}, leaf)

        leaf = max(4, -(-widest(nested) // 2))
        if leaf > 32767:
            raise ValueError("a group holds 65,534 members at most")
        root = made(nested)
        self.data[:96] = SIGNATURE + struct.pack("<8B", 0, 0, 0, 0, 0, 8, 8, 0) + struct.pack("<HHI4Q", leaf, 16, 0, 0, NONE, len(self.data), NONE) + struct.pack("<QQI4xQQ", 0, root[0], 1, *root[1:])
        return bytes(self.data)


class Hdf5Writer(DataSourceArrowWriter):
    """Files of about FILE_BYTES for each task, with a group for each member that has rows in it."""

    def __init__(self, job: Job):
        self.job = job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task, names, rows, held, size = TaskContext.get(), [], 0, [], 0

        def close() -> None:
            name = f"part-{task.partitionId():05d}-{self.job.id}-{task.taskAttemptId()}-{len(names):04d}.h5"
            with self.job.open(name) as out:
                out.write(Out().tree(arrays(pa.Table.from_batches(held))))
            names.append(name)

        for batch in iterator:
            while batch.num_rows:
                n = max(1, min(batch.num_rows, FILE_BYTES * batch.num_rows // max(1, batch.nbytes)))
                held.append(batch.slice(0, n))
                rows, size, batch = rows + n, size + held[-1].nbytes, batch.slice(n)
                if size >= FILE_BYTES:
                    close()
                    held, size = [], 0
        if held:
            close()
        return Written(tuple(names), rows)

    def commit(self, messages) -> None:
        self.job.commit(messages)

    def abort(self, messages) -> None:
        self.job.clear()


def arrays(table: pa.Table) -> dict[str, np.ndarray]:
    """Datasets by path; rows of one member that lie apart come together."""
    member = np.array(table.column("member").to_pylist(), object)
    out = {}
    for m in dict.fromkeys(member):
        if not m or any(not x for x in m.split("/")):
            raise ValueError(f"{m!r} names no group")
        part = table.filter(pa.array(member == m))
        for c in table.column_names:
            if c == "member":
                continue
            values = part.column(c).combine_chunks()
            if pa.types.is_list(values.type):
                width = np.unique(np.diff(values.offsets.to_numpy()))
                if len(width) > 1 or values.null_count or values.flatten().null_count:
                    raise ValueError(f"{m}/{c}: nulls, or arrays of different lengths")
                out[f"{m}/{c}"] = values.flatten().to_numpy().astype(np.float64).reshape(len(values), -1)
            elif pa.types.is_string(values.type):
                text = [x.encode() for x in values.fill_null("").to_pylist()]
                out[f"{m}/{c}"] = np.array(text, f"S{max(1, *map(len, text)) if text else 1}")
            elif pa.types.is_floating(values.type):
                out[f"{m}/{c}"] = values.cast(pa.float64()).fill_null(float("nan")).to_numpy()
            elif values.null_count:
                raise ValueError(f"{m}/{c}: integers have no null")
            else:
                out[f"{m}/{c}"] = values.cast(pa.int64()).to_numpy(zero_copy_only=False)
    return out


class Hdf5(DataSource):
    """format("hdf5") with a schema: a row for each row of the groups that have all its columns; file, member and row tell which."""

    @classmethod
    def name(cls) -> str:
        return "hdf5"

    def schema(self) -> str:
        raise ValueError("name the datasets by a schema")

    def reader(self, schema) -> Hdf5Reader:
        return Hdf5Reader(self.options["path"], schema)

    def writer(self, schema, overwrite: bool) -> Hdf5Writer:
        return Hdf5Writer(Job(self.options["path"], overwrite, ".h5"))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Hdf5)


def write_hdf5(rows: DataFrame, path: str, order: Sequence[str] = (), mode: str = "append") -> None:
    """rows(member, ...) as groups of datasets, dealt out by ranges of (member, order); all files appear, or none.

    Strings are of fixed length (a null is empty, blanks at the end go), numbers 64 bits wide (a null fraction is NaN, a
    null integer an error), arrays of one length in a member. A member that many tasks have lies in many files.
    """
    register(rows.sparkSession)
    rows.repartitionByRange("member", *order).sortWithinPartitions("member", *order).write.format("hdf5").mode(mode).save(path)


def read_hdf5(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file's or a folder's groups (S14, S15); a filter on member opens those groups only, one on another column decodes only blocks with such rows."""
    register(spark)
    return spark.read.format("hdf5").schema(schema).load(path)
