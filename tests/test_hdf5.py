"""HDF5 source and sink: round trips, blocks that a filter skips, files that aren't read; Gaussian smoothing against numpy."""

import struct
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo

from lodestrand.operators import smoothing
from lodestrand.sources import hdf5


@pytest.fixture
def folder():
    return tempfile.mkdtemp(dir="/tmp", prefix="spark-")


def test_datasets_of_every_kind_by_ranges(folder):
    r = np.random.default_rng(1)
    own = {"a/b/x": r.normal(size=200_000), "a/b/n": np.arange(200_000), "a/b/g": np.array([b"g%d" % (k % 7) for k in range(200_000)]), "c/m": r.normal(size=(3000, 5)), "c/none": np.zeros(0), "top": np.arange(3)}
    with open(f"{folder}/x.h5", "wb") as f:
        f.write(hdf5.Out().tree(own))
    with hdf5.File(f"{folder}/x.h5") as f:
        seen = set()
        for path, found in f.groups(None):
            for name, messages in found.items():
                want = own[full := f"{path}/{name}".lstrip("/")]
                seen.add(full)
                d = f.dataset(messages)
                for low, high in ((0, len(want)), (len(want) // 3, len(want) // 2), (len(want), len(want))):
                    assert (f.rows(d, low, high).reshape(want[low:high].shape) == want[low:high]).all(), full
        assert seen == set(own)
        d = f.dataset(dict(f.groups({"a/b"}))["a/b"]["x"])
        before = f.read
        f.rows(d, 150_000, 150_010)
        assert f.read - before < 30_000  # of 1.6 MB: one chunk of 1,024 rows and a path through the tree


def test_contiguous_big_endian_and_fill(folder):
    """Headers as other writers make them: a run of bytes, and a dataset that was never written."""
    out = hdf5.Out()
    at = out.add(np.arange(12, dtype=">f4").tobytes())
    real = struct.pack("<BBBBIHHBBBBI", 0x11, 0x21, 31, 0, 4, 0, 32, 23, 8, 0, 23, 127)
    space = struct.pack("<BBBx4x2Q", 1, 2, 0, 4, 3)
    whole = out.header([(hdf5.DATASPACE, space), (hdf5.DATATYPE, real), (hdf5.LAYOUT, struct.pack("<BBQQ", 3, 1, at, 48))])
    unwritten = out.header([(hdf5.DATASPACE, space), (hdf5.DATATYPE, real), (hdf5.FILL, struct.pack("<BBBBI", 2, 2, 0, 1, 4) + np.array(7, ">f4").tobytes()), (hdf5.LAYOUT, struct.pack("<BBQQ", 3, 1, hdf5.NONE, 0))])
    root = out.group({"x": whole, "y": unwritten}, 4)
    out.data[:96] = hdf5.SIGNATURE + struct.pack("<8B", 0, 0, 0, 0, 0, 8, 8, 0) + struct.pack("<HHI4Q", 4, 16, 0, 0, hdf5.NONE, len(out.data), hdf5.NONE) + struct.pack("<QQI4xQQ", 0, root[0], 1, *root[1:])
    with open(f"{folder}/x.h5", "wb") as f:
        f.write(bytes(out.data))
    with hdf5.File(f"{folder}/x.h5") as f:
        found = dict(f.groups(None))[""]
        assert f.rows(f.dataset(found["x"]), 1, 3).tolist() == [[3, 4, 5], [6, 7, 8]]
        assert (f.rows(f.dataset(found["y"]), 0, 4) == 7).all()


def test_spark_round_trip_and_filters(spark, folder, monkeypatch):
    rows = spark.range(30_000).select(
        F.concat(F.lit("set"), F.col("id") % 3, F.lit("/deep")).alias("member"), F.col("id").alias("key"), F.format_string("G%05d", F.floor(F.col("id") / 100)).alias("gene"),
        F.when(F.col("id") % 10 > 0, F.col("id") / 7).alias("score"), F.array(F.col("id") * 1.0, F.lit(0.5)).alias("pair"),
    )
    hdf5.write_hdf5(rows, folder, order=("key",))
    schema = "member string, key long, gene string, score double, pair array<double>"
    read = hdf5.read_hdf5(spark, folder, schema)
    want = rows.withColumn("score", F.coalesce("score", F.lit(float("nan"))))
    assert read.count() == 30_000 and read.exceptAll(want).count() == 0 and want.exceptAll(read).count() == 0
    assert {r["key"] for r in read.where("gene = 'G00123'").collect()} == set(range(12_300, 12_400))
    assert read.where("member = 'set1/deep'").count() == 10_000
    assert hdf5.read_hdf5(spark, folder, "nothing long").count() == 0

    reader = hdf5.Hdf5Reader(folder, T._parse_datatype_string(schema))
    assert len(list(reader.pushFilters([EqualTo(("gene",), "G00123"), EqualTo(("member",), "set1/deep")]))) == 2
    monkeypatch.setattr(hdf5, "DECODED_BYTES", 1)
    decoded = []
    rows_of = hdf5.File.rows
    monkeypatch.setattr(hdf5.File, "rows", lambda self, d, low, high: decoded.append(d.kind.kind) or rows_of(self, d, low, high))
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert all(p.member in ("set1/deep", "") for p in reader.partitions())
    assert sum(len(b) for b in got) == len([k for k in range(12_300, 12_400) if k % 3 == 1])
    assert decoded.count("S") >= 10 and len(decoded) - decoded.count("S") <= 6  # the other columns of a chunk or two only


def test_what_is_not_read(spark, folder):
    with open(f"{folder}/x.h5", "wb") as f:
        f.write(hdf5.SIGNATURE + b"\2" + bytes(100))
    with pytest.raises(ValueError, match="superblock"):
        hdf5.File(f"{folder}/x.h5")
    one = spark.createDataFrame([("a", None)], "member string, n long")
    with pytest.raises(Exception, match="no null"):
        hdf5.write_hdf5(one, f"{folder}/none")
    assert hdf5.read_hdf5(spark, f"{folder}/none", "member string, n long").count() == 0


def smooth(m, sigma, truncate):
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        wide = np.pad(m, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        m = np.apply_along_axis(lambda x: np.convolve(x, w, "valid"), axis, wide)
    return m


@pytest.mark.parametrize("shape, sigma, truncate", [((70, 130), 1.5, 4.0), ((3, 2), 2.0, 4.0), ((1, 65), 1.0, 2.0)])
def test_smoothing(spark, shape, sigma, truncate):
    m = np.random.default_rng(3).normal(size=shape)
    cells = [("a", i, j, float(m[i, j])) for i in range(shape[0]) for j in range(shape[1])] + [(None, 0, 0, 1.0), (None, None, 0, 1.0)]
    got = smoothing.gaussian(spark.createDataFrame(cells, "matrix string, i long, j long, v double"), ["matrix"], sigma, truncate).collect()
    out = np.full(shape, np.nan)
    for r in got:
        if r["matrix"] == "a":
            out[r["i"], r["j"]] = r["v"]
    assert np.allclose(out, smooth(m, sigma, truncate), atol=1e-12)
    assert [abs(r["v"] - 1) < 1e-12 for r in got if r["matrix"] is None] == [True]
