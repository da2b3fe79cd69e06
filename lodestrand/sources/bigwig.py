"""BigWig tracks as a data source: blocks found through the file's index are the partitions, filters open only those they need."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators import intervals
from ..session import ship
from . import text
from .store import Job, Written, listed, place

#: Fixed values of the format: the marks of the file, of its list of chromosomes and of its index; kinds of section.
MAGIC, CHROMS_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BED_GRAPH, VARIABLE_STEP, FIXED_STEP = 1, 2, 3
#: Items of a section and entries of an index node that the sink writes; compressed bytes that go to one partition.
ITEMS, FAN_OUT, PARTITION_BYTES = 1024, 256, 1 << 22
SCHEMA = "chrom string, start long, end long, value float"


class Track:
    """One file's header, chromosomes and index, read as needed."""

    def __init__(self, path: str):
        system, at = place(path)
        self.path, self.file = path, system.open_input_file(at)
        head = self.file.read_at(64, 0)
        self.order = next((o for o in "<>" if struct.unpack(f"{o}I", head[:4])[0] == MAGIC), None)
        if self.order is None:
            raise ValueError(f"{path} is no BigWig file")
        _, _, _, chroms, _, self.index, _, _, _, _, self.plain_size, _ = struct.unpack(f"{self.order}IHHQQQHHQQIQ", head)
        self.chroms = dict(self._chroms(chroms))
        self.names = {i: name for name, (i, _) in self.chroms.items()}

    def unpack(self, form: str, at: int) -> tuple:
        form = self.order + form
        return struct.unpack(form, self.file.read_at(struct.calcsize(form), at))

    def _chroms(self, at: int) -> Iterator[tuple[str, tuple[int, int]]]:
        """(name, (number, size)) from the tree of chromosomes."""
        magic, _, key, _, _, _ = self.unpack("IIIIQQ", at)
        if magic != CHROMS_MAGIC:
            raise ValueError(f"{self.path} has no list of chromosomes")
        waiting = [at + 32]
        while waiting:
            node = waiting.pop()
            leaf, _, n = self.unpack("BBH", node)
            size = key + 8
            raw = self.file.read_at(n * size, node + 4)
            for i in range(n):
                name, rest = raw[i * size : i * size + key].rstrip(b"\0").decode(), raw[i * size + key : (i + 1) * size]
                if leaf:
                    yield name, struct.unpack(f"{self.order}II", rest)
                else:
                    waiting.append(struct.unpack(f"{self.order}Q", rest)[0])

    def blocks(self, wanted: dict[str, tuple[int, int]] | None) -> list[tuple[int, int]]:
        """(offset, bytes) of the blocks that may hold an item in reach; wanted: for each chromosome (low, high), None for all.

        Only index nodes that may lead to such a block are read.
        """
        reach = None if wanted is None else {self.chroms[c][0]: r for c, r in wanted.items() if c in self.chroms}

        def meets(c0: int, s: int, c1: int, e: int) -> bool:
            if reach is None:
                return True
            return any((c0, s) <= (c, high) and (c, low) <= (c1, e) for c, (low, high) in reach.items())

        if self.unpack("I", self.index)[0] != INDEX_MAGIC:
            raise ValueError(f"{self.path} has no index")
        found, waiting = [], [self.index + 48]
        while waiting:
            node = waiting.pop()
            leaf, _, n = self.unpack("BBH", node)
            form = struct.Struct(f"{self.order}IIIIQQ" if leaf else f"{self.order}IIIIQ")
            for item in form.iter_unpack(self.file.read_at(n * form.size, node + 4)):
                if meets(*item[:4]):
                    if leaf:
                        found.append(item[4:])
                    else:
                        waiting.append(item[4])
        return sorted(found)

    def items(self, offset: int, size: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """(chrom, starts, ends, values) of a block."""
        raw = self.file.read_at(size, offset)
        raw = zlib.decompress(raw) if self.plain_size else raw
        chrom, start, _, step, span, kind, _, n = struct.unpack(f"{self.order}IIIIIBBH", raw[:24])
        u, f = f"{self.order}u4", f"{self.order}f4"
        if kind == BED_GRAPH:
            rows = np.frombuffer(raw, [("s", u), ("e", u), ("v", f)], n, 24)
            s, e, v = rows["s"], rows["e"], rows["v"]
        elif kind == VARIABLE_STEP:
            rows = np.frombuffer(raw, [("s", u), ("v", f)], n, 24)
            s, e, v = rows["s"], rows["s"] + span, rows["v"]
        else:
            v = np.frombuffer(raw, f, n, 24)
            s = start + step * np.arange(n)
            e = s + span
        return self.names[chrom], s.astype(np.int64), e.astype(np.int64), v.astype(np.float32)


class Blocks(InputPartition):
    """Blocks of one file that are read by one task."""

    def __init__(self, path: str, blocks: list[tuple[int, int]]):
        self.path, self.blocks = path, blocks


class BigWigReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.chroms, self.low, self.high = path, None, 0, 1 << 40

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Chromosomes and bounds of start and end choose the blocks; Spark still applies every filter to the rows."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "chrom" and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chroms = own if self.chroms is None else self.chroms & own
            elif column in ("start", "end") and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value)  # an item that begins after it ends after it too
            elif column in ("start", "end") and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path, _ in listed(self.path, (".bw", ".bigwig")):
            track = Track(path)
            chroms = self.chroms if self.chroms is not None else track.chroms if self.low > 0 or self.high < 1 << 40 else None
            run, size = [], 0
            for block in track.blocks(None if chroms is None else {c: (self.low, self.high) for c in chroms}):
                if run and size + block[1] > PARTITION_BYTES:
                    out.append(Blocks(path, run))
                    run, size = [], 0
                run.append(block)
                size += block[1]
            if run:
                out.append(Blocks(path, run))
        return out or [Blocks("", [])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        track = Track(partition.path) if partition.blocks else None
        for offset, size in partition.blocks:
            chrom, s, e, v = track.items(offset, size)
            yield pa.record_batch([pa.array([chrom] * len(s), pa.string()), pa.array(s), pa.array(e), pa.array(v)], names=["chrom", "start", "end", "value"])


class BigWigWriter(DataSourceArrowWriter):
    """A file for each task, from rows that come by chromosome and start; sizes: of chromosomes, else the furthest end."""

    def __init__(self, job: Job):
        self.job = job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.job.id}-{task.taskAttemptId()}.bw"
        rows, sections, sizes = 0, [], {}
        batches = (b for b in iterator if b.num_rows)
        first = next(batches, None)
        if first is None:
            return Written(())
        with self.job.open(name) as out:
            # the place of the list of chromosomes and of the index is known at the end only, and streams don't go back:
            # sections wait compressed, as they do in the format's own tools
            for batch in (first, *batches):
                rows += batch.num_rows
                chrom = batch.column("chrom").to_numpy(zero_copy_only=False)
                s, e, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "end", "value"))
                cuts = [0, *(np.flatnonzero(chrom[1:] != chrom[:-1]) + 1).tolist(), len(chrom)]
                for a, b in zip(cuts, cuts[1:]):
                    for i in range(a, b, ITEMS):
                        j = min(b, i + ITEMS)
                        own = np.empty(j - i, [("s", "<u4"), ("e", "<u4"), ("v", "<f4")])
                        own["s"], own["e"], own["v"] = s[i:j], e[i:j], v[i:j]
                        number = sizes.setdefault(chrom[a], [len(sizes), 0])
                        number[1] = max(number[1], int(e[i:j].max()))
                        head = struct.pack("<IIIIIBBH", number[0], int(s[i]), int(e[i:j].max()), 0, 0, BED_GRAPH, 0, j - i)
                        sections.append((number[0], int(s[i]), int(e[i:j].max()), zlib.compress(head + own.tobytes())))
            out.write(self.whole(sections, sizes))
        return Written((name,), rows)

    @staticmethod
    def whole(sections: list[tuple[int, int, int, bytes]], sizes: dict[str, list[int]]) -> bytes:
        key = max(len(c.encode()) for c in sizes)
        names = sorted(sizes, key=lambda c: c.encode())
        chroms = struct.pack("<IIIIQQ", CHROMS_MAGIC, max(2, len(names)), key, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names))
        chroms += b"".join(c.encode().ljust(key, b"\0") + struct.pack("<II", *sizes[c]) for c in names)
        data_at = 64 + len(chroms)
        offset, leaves = data_at + 8, []
        for c, s, e, z in sections:
            leaves.append((c, s, c, e, offset, len(z)))
            offset += len(z)
        levels = [leaves]
        while len(levels[-1]) > FAN_OUT:
            level = [levels[-1][i : i + FAN_OUT] for i in range(0, len(levels[-1]), FAN_OUT)]
            levels.append([(*g[0][:2], *max((x[2], x[3]) for x in g), None) for g in level])
        levels.reverse()
        # level by level from the root; a node has FAN_OUT entries or fewer
        shape = [struct.Struct("<IIIIQQ" if i == len(levels) - 1 else "<IIIIQ") for i in range(len(levels))]
        index, at = b"", offset + 48
        starts = []
        for entries, form in zip(levels, shape):
            nodes = [entries[i : i + FAN_OUT] for i in range(0, len(entries), FAN_OUT)]
            starts.append([])
            for node in nodes:
                starts[-1].append(at)
                at += 4 + len(node) * form.size
        for i, (entries, form) in enumerate(zip(levels, shape)):
            for k in range(0, len(entries), FAN_OUT):
                node = entries[k : k + FAN_OUT]
                leaf = i == len(levels) - 1
                index += struct.pack("<BBH", leaf, 0, len(node))
                index += b"".join(form.pack(*x) if leaf else form.pack(*x[:4], starts[i + 1][k + n]) for n, x in enumerate(node))
        low, high = leaves[0], max((x[2], x[3]) for x in leaves)
        head = struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, 0, 64, data_at, offset, 0, 0, 0, 0, 24 + 12 * ITEMS, 0)
        top = struct.pack("<IIQIIIIQII", INDEX_MAGIC, FAN_OUT, len(leaves), low[0], low[1], *high, offset, 1, 0)
        return b"".join([head, chroms, struct.pack("<Q", len(sections)), *(z for *_, z in sections), top, index])

    def commit(self, messages) -> None:
        self.job.commit(messages)

    def abort(self, messages) -> None:
        self.job.clear()


class BigWig(DataSource):
    """format("bigwig"): rows of SCHEMA, a run of equal values each."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BigWigReader:
        return BigWigReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> BigWigWriter:
        return BigWigWriter(Job(self.options["path"], overwrite, ".bw"))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BigWig)


def write_bigwig(runs: DataFrame, path: str, mode: str = "append") -> None:
    """runs(chrom, start, end, value) as BigWig files, chromosomes dealt out by ranges of (chrom, start) (a sink for S12)."""
    register(runs.sparkSession)
    rows = runs.select(F.col("chrom").cast("string"), F.col("start").cast("long"), F.col("end").cast("long"), F.col("value").cast("float"))
    rows = rows.where("chrom IS NOT NULL AND start IS NOT NULL AND `end` > start AND value IS NOT NULL")
    rows.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.format("bigwig").mode(mode).save(path)


def read_track(spark: SparkSession, path: str) -> DataFrame:
    """Runs (chrom, start, end, value) of a track by its name's ending, `.gz` aside (S12): BigWig by the data source;
    BED and narrowPeak as the union of their intervals with the value 1 (S13); bedGraph lines as they are."""
    name = path.lower().removesuffix(".gz").rstrip("/")
    if name.endswith((".bw", ".bigwig")):
        register(spark)
        return spark.read.format("bigwig").load(path)
    if name.endswith((".bed", ".narrowpeak")):
        return intervals.merged(text.bed(text.lines(spark, path)).where("`end` > start").select("chrom", "start", "end")).select("chrom", "start", "end", F.lit(1.0).cast("float").alias("value"))
    if name.endswith((".bedgraph", ".bg")):
        rows = text.fields(text.lines(spark, path).where("value NOT LIKE 'track%' AND value NOT LIKE 'browser%'"), ("chrom", "start", "end", "v"), r"\s+", 4)
        return rows.select("chrom", F.expr("try_cast(start AS BIGINT)").alias("start"), F.expr("try_cast(`end` AS BIGINT)").alias("end"), F.expr("try_cast(v AS FLOAT)").alias("value"))
    raise ValueError(f"no reader for {path}")


#: The largest half-precision number, at which values are clipped.
HALF = 65504.0


def read_windows(track: DataFrame, windows: DataFrame, bin_width: int = 1 << 14) -> DataFrame:
    """windows(chrom, start, end, ...) with `values`, an array with a value for each position (S12): 0 where the track has
    none or ends, infinite ones clipped to half precision's range. Windows must not repeat; nulls give an empty array.

    Runs meet windows by shared bins; a window's runs, in order, repeat their values, with zeros between.
    """
    own = windows.columns
    pairs = intervals.clipped(intervals.overlap_join(windows, track.select("chrom", "start", "end", F.least(F.greatest("value", F.lit(-HALF)), F.lit(HALF)).cast("float").alias("value")), bin_width))
    runs = pairs.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("clip_start", "clip_end", "value_b"))).alias("__runs"))
    joined = windows.join(runs, own, "left")
    zero = F.lit(0.0).cast("float")
    repeat = lambda v, n: F.array_repeat(v, n.cast("int"))
    filled = F.flatten(F.transform("__runs", lambda r, i: F.concat(repeat(zero, r["clip_start"] - F.when(i > 0, F.get("__runs", i - 1)["clip_end"]).otherwise(F.col("start"))), repeat(r["value_b"], r["clip_end"] - r["clip_start"]))))
    rest = repeat(zero, F.greatest(F.col("end") - F.coalesce(F.element_at("__runs", -1)["clip_end"], F.col("start")), F.lit(0)))
    return joined.withColumn("values", F.concat(F.coalesce(filled, F.expr("CAST(array() AS array<float>)")), F.coalesce(rest, F.expr("CAST(array() AS array<float>)")))).drop("__runs")
