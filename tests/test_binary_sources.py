"""BigWig, TFRecord and NumPy sources and sinks: round trips, pruned reads, damaged files, failed and resumed jobs."""

import os
import random
import struct
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

from lodestrand.sources import bigwig, npz, resume, tfrecord


@pytest.fixture
def folder():
    return tempfile.mkdtemp(dir="/tmp", prefix="spark-")


def track(rows, per_section=4):
    """A BigWig's bytes from (chrom, start, end, value) in order."""
    sizes, sections, own = {}, [], {}
    for c, s, e, v in rows:
        own.setdefault(c, []).append((s, e, v))
    for c, items in own.items():
        sizes[c] = [len(sizes), max(e for _, e, _ in items)]
        for i in range(0, len(items), per_section):
            part = items[i : i + per_section]
            last = max(e for _, e, _ in part)
            head = struct.pack("<IIIIIBBH", sizes[c][0], part[0][0], last, 0, 0, 1, 0, len(part))
            sections.append((sizes[c][0], part[0][0], last, zlib.compress(head + b"".join(struct.pack("<IIf", *x) for x in part))))
    return bigwig.BigWigWriter.whole(sections, sizes)


def test_bigwig_round_trip_and_filters(spark, folder):
    rnd = random.Random(4)
    rows, at = [], 0
    for c in ("chrA", "chrBB", "chrC"):
        at = 0
        for _ in range(3000):
            at += rnd.randrange(3)
            end = at + rnd.randrange(1, 5)
            rows.append((c, at, end, float(rnd.randrange(8)) / 2))
            at = end
    bigwig.write_bigwig(spark.createDataFrame(rows + [(None, 1, 2, 1.0), ("chrA", 5, 5, 1.0)], "chrom string, start long, end long, value double"), f"{folder}/t.bw")
    df = bigwig.read_track(spark, f"{folder}/t.bw")
    assert sorted(tuple(r) for r in df.collect()) == sorted(rows)
    some = df.where("chrom = 'chrBB' AND start < 700 AND `end` > 300")
    assert sorted(tuple(r) for r in some.collect()) == sorted(r for r in rows if r[0] == "chrBB" and r[1] < 700 and r[2] > 300)
    assert df.where("chrom = 'none'").count() == 0


def test_bigwig_filter_opens_few_blocks(monkeypatch, folder):
    monkeypatch.setattr(bigwig, "FAN_OUT", 4)
    rows = [(c, 10 * i, 10 * i + 7, float(i)) for c in ("c1", "c2") for i in range(1000)]
    with open(f"{folder}/t.bw", "wb") as f:
        f.write(track(rows))
    whole = bigwig.BigWigReader(f"{folder}/t.bw")
    assert sum(len(p.blocks) for p in whole.partitions()) == 500
    got = sorted((c, int(s), int(e), float(v)) for p in whole.partitions() for b in whole.read(p) for c, s, e, v in zip(*(x.to_pylist() for x in b.columns)))
    assert got == rows
    reader = bigwig.BigWigReader(f"{folder}/t.bw")
    kept = list(reader.pushFilters([EqualTo(("chrom",), "c2"), LessThan(("start",), 5050), GreaterThan(("end",), 5000)]))
    assert len(kept) == 3  # Spark applies them to the rows too
    assert sum(len(p.blocks) for p in reader.partitions()) <= 3
    reads = []
    opened = bigwig.Track(f"{folder}/t.bw")
    plain = opened.file

    class Counting:
        def read_at(self, n, at):
            reads.append(n)
            return plain.read_at(n, at)

    opened.file = Counting()
    opened.blocks({"c2": (5000, 5050)})
    assert sum(reads) < 3000 < os.path.getsize(f"{folder}/t.bw")


def test_bigwig_other_sections(folder):
    data = bytearray(track([("c", 0, 4, 1.0)]))
    with open(f"{folder}/t.bw", "wb") as f:
        f.write(data)
    t = bigwig.Track(f"{folder}/t.bw")

    class Plain:
        def __init__(self, raw):
            self.raw = raw

        def read_at(self, n, at):
            return zlib.compress(self.raw)

    t.file = Plain(struct.pack("<IIIIIBBH", 0, 0, 0, 0, 5, 2, 0, 2) + struct.pack("<IfIf", 10, 1.5, 40, 2.5))
    c, s, e, v = t.items(0, 0)
    assert (c, s.tolist(), e.tolist(), v.tolist()) == ("c", [10, 40], [15, 45], [1.5, 2.5])
    t.file = Plain(struct.pack("<IIIIIBBH", 0, 100, 0, 20, 5, 3, 0, 3) + struct.pack("<fff", 1, 2, 3))
    c, s, e, v = t.items(0, 0)
    assert (s.tolist(), e.tolist(), v.tolist()) == ([100, 120, 140], [105, 125, 145], [1, 2, 3])
    with open(f"{folder}/no.bw", "wb") as f:
        f.write(b"x" * 100)
    with pytest.raises(ValueError):
        bigwig.Track(f"{folder}/no.bw")


def test_windows_of_a_track(spark):
    t = spark.createDataFrame([("a", 2, 4, 1.0), ("a", 4, 5, 3.0), ("a", 8, 9, float("inf"))], "chrom string, start long, end long, value float")
    w = spark.createDataFrame([("a", 0, 10, 1), ("a", 3, 5, 2), ("b", 0, 2, 3), ("a", 8, 8, 4), ("a", 9, 12, 5)], "chrom string, start long, end long, id int")
    got = {r["id"]: r["values"] for r in bigwig.read_windows(t, w, 4).collect()}
    assert got == {1: [0, 0, 1, 1, 3, 0, 0, 0, 65504, 0], 2: [1, 3], 3: [0, 0], 4: [], 5: [0, 0, 0]}


def test_track_by_name(spark, folder):
    with open(f"{folder}/x.bed", "w") as f:
        f.write("c\t1\t5\nc\t4\t9\nc\t9\t12\nd\t3\t3\n")
    with open(f"{folder}/x.bedgraph", "w") as f:
        f.write("track type=bedGraph\nc 1 5 0.5\nc\t5\t6\t2\n")
    assert [tuple(r) for r in bigwig.read_track(spark, f"{folder}/x.bed").collect()] == [("c", 1, 12, 1.0)]
    assert sorted(tuple(r) for r in bigwig.read_track(spark, f"{folder}/x.bedgraph").collect()) == [("c", 1, 5, 0.5), ("c", 5, 6, 2.0)]
    with pytest.raises(ValueError):
        bigwig.read_track(spark, "x.wig2")


def test_crc32c():
    assert tfrecord.crc32c(b"") == 0
    assert tfrecord.crc32c(b"123456789") == 0xE3069283  # the checksum's published example
    assert tfrecord.crc32c(b"\0" * 32) == 0x8A9136AA
    rnd = random.Random(2)
    data = bytes(rnd.randrange(256) for _ in range(2000))
    plain = 0xFFFFFFFF
    for b in data:
        plain ^= b
        for _ in range(8):
            plain = plain >> 1 ^ (0x82F63B78 if plain & 1 else 0)
    assert tfrecord.crc32c(data) == plain ^ 0xFFFFFFFF


ROWS = [(i, bytes(range(i % 256)) * 9, "é" * (i % 3), [float(i), -0.5], [-i, i, 1 << 40], None if i % 4 else [b"a", b""]) for i in range(200)]
SCHEMA = "id long, raw binary, name string, xs array<float>, ns array<long>, parts array<binary>"


@pytest.mark.parametrize("compression", ["ZLIB", "none"])
def test_tfrecord_round_trip(spark, folder, compression):
    tfrecord.register(spark)
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    df.write.format("tfrecord").option("records", 32).option("compression", compression).mode("append").save(f"{folder}/t")
    files = [f for f in os.listdir(f"{folder}/t")]
    assert all(f.endswith(".tfr") for f in files) and len(files) >= 7
    got = sorted(tfrecord.read_tfrecords(spark, f"{folder}/t", SCHEMA).collect())
    assert [(r.id, bytes(r.raw), r.name, r.xs, r.ns, r.parts and [bytes(x) for x in r.parts]) for r in got] == ROWS
    assert set(tfrecord.read_tfrecords(spark, f"{folder}/t").columns) >= {"id", "raw", "name", "xs", "ns"}
    tfrecord.write_tfrecords(df.where("id < 5"), f"{folder}/t", mode="overwrite")
    assert tfrecord.read_tfrecords(spark, f"{folder}/t", "id long").count() == 5


def test_tfrecord_damage_is_reported(spark, folder):
    tfrecord.register(spark)
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.format("tfrecord").option("compression", "none").option("records", 1000).mode("append").save(f"{folder}/t")
    name = f"{folder}/t/{os.listdir(f'{folder}/t')[0]}"
    good = open(name, "rb").read()
    for damaged in (good[:50_000] + bytes([good[50_000] ^ 1]) + good[50_001:], good[:-3], b"\0" + good[1:]):
        with open(name, "wb") as f:
            f.write(damaged)
        with pytest.raises(Exception, match="damaged|ends early"):
            tfrecord.read_tfrecords(spark, f"{folder}/t", "id long").collect()


def test_failed_job_leaves_no_file(spark, folder):
    bad = spark.range(400).repartition(4).withColumn("x", F.expr("IF(id = 390, raise_error('half way'), 1)").cast("long"))
    for write in (lambda: tfrecord.write_tfrecords(bad, f"{folder}/t"), lambda: bigwig.write_bigwig(bad.select(F.lit("c").alias("chrom"), F.col("id").alias("start"), (F.col("id") + F.col("x")).alias("end"), F.col("x").alias("value")), f"{folder}/t")):
        with pytest.raises(Exception, match="half way"):
            write()
        assert not os.path.isdir(f"{folder}/t") or os.listdir(f"{folder}/t") == []


def test_resume_runs_what_is_missing(spark, folder):
    rows = spark.range(300).withColumn("part", F.col("id") % 6).withColumn("name", F.concat(F.lit("n"), "id"))
    bad = rows.withColumn("name", F.expr("IF(part = 4, raise_error('a lost part'), name)"))
    with pytest.raises(Exception, match="a lost part"):
        resume.write_parts(bad, F.col("part"), folder)
    assert resume.write_parts(rows, F.col("part"), folder) != []
    assert resume.write_parts(rows, F.col("part"), folder) == []
    os.remove(f"{folder}/{resume.marker('train', 2)}")
    with open(f"{folder}/{resume.marker('train', 5)}", "w") as f:
        f.write("{")
    assert resume.write_parts(rows, F.col("part"), folder) == [(2, 50, 2), (5, 50, 2)]
    fewer = rows.where("NOT (part = 3 AND id > 100)")
    assert resume.write_parts(fewer, F.col("part"), folder) == [(3, 17, 1)]
    got = sorted(tuple(r) for r in tfrecord.read_tfrecords(spark, folder, "id long, part long, name string").collect())
    assert got == sorted(tuple(r) for r in fewer.collect())
    assert not [f for f in os.listdir(folder) if f.startswith("_")]


def test_resume_goes_on_after_a_failure(spark, folder):
    """Parts that were marked before another one failed aren't written again."""
    rows = spark.range(60).withColumn("part", F.col("id") % 3)
    assert [p for p, _, _ in resume.write_parts(rows.where("part < 2"), F.col("part"), folder)] == [0, 1]
    assert resume.write_parts(rows, F.col("part"), folder) == [(2, 20, 1)]


@pytest.mark.parametrize("dtype", ["float16", "float32", "int32"])
def test_npz_round_trip(spark, folder, dtype):
    rnd = np.random.default_rng(1)
    want = {"flat": rnd.integers(0, 100, 700), "two": rnd.integers(0, 100, (50, 3)), "three": rnd.integers(0, 100, (40, 4, 5))}
    rows = [(m, i, list(a.shape[1:]), [float(x) for x in np.ravel(r)]) for m, a in want.items() for i, r in enumerate(a)]
    df = spark.createDataFrame(rows, "member string, row long, shape array<long>, values array<double>").repartition(5)
    npz.write_npz(df, f"{folder}/a", dtype)
    got = sorted(npz.read_npz(spark, f"{folder}/a").collect())
    assert [(r.member, r.row, r["shape"], r["values"]) for r in got] == sorted(rows)
    assert npz.read_npz(spark, f"{folder}/a", "two").count() == 50
    loaded = [np.load(f"{folder}/a/{f}") for f in sorted(os.listdir(f"{folder}/a"))]
    assert np.array_equal(np.concatenate([x["three"] for x in sorted((x for x in loaded if "three" in x), key=lambda x: int(x["three.first_row"]))]), want["three"])


def test_npz_arrays_are_split(spark, folder, monkeypatch):
    monkeypatch.setattr(npz, "PARTITION_BYTES", 1000)
    big, by_column = np.arange(6000, dtype=np.float32).reshape(300, 20), np.asfortranarray(np.arange(12.0).reshape(4, 3))
    np.savez(f"{folder}/x.npz", big=big, one=np.float64(7), by_column=by_column)
    np.savez_compressed(f"{folder}/y.npz", deflated=big.astype(np.float16))
    reader = npz.NpzReader(folder, None)
    parts = reader.partitions()
    assert sum(p.member == "big.npy" for p in parts) == 25 and sum(p.member == "deflated.npy" for p in parts) == 1
    got = {}
    for p in parts:
        for b in reader.read(p):
            for m, r, v in zip(*(b.column(c).to_pylist() for c in ("member", "row", "values"))):
                got[m, r] = v
    assert [got["big", i] for i in range(300)] == big.tolist()
    assert [got["deflated", i] for i in range(300)] == big.astype(np.float16).tolist()
    assert [got["by_column", i] for i in range(4)] == by_column.tolist() and got["one", 0] == [7]
    with open(f"{folder}/z.npz", "wb") as f:
        np.savez(f, big=np.array([1 << 60, (1 << 60) + 1]))
    with pytest.raises(ValueError):
        list(npz.NpzReader(f"{folder}/z.npz", None).read(npz.NpzReader(f"{folder}/z.npz", None).partitions()[0]))
