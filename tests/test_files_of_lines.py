"""Half floats against numpy, verdicts, BED files by label, fields by name or place."""

import tempfile

import numpy as np
from pyspark.sql import functions as F

from lodestrand.functions import columns as C
from lodestrand.sources import text


def test_half_equals_numpy(spark):
    r = np.random.default_rng(2)
    halves = np.arange(1, 0x7BFF, 7, dtype=np.uint16).view(np.float16).astype(float)
    x = [0.0, 1.0, 65504.0, 65519.0, 65520.0, 1e9, -1e9, 2.0**-24, 2.0**-25, 1.5 * 2.0**-24, *halves[:2000], *((halves[:-1] + halves[1:]) / 2)[:2000], *(r.normal(size=2000) * 10.0 ** r.integers(-8, 5, 2000))]
    got = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", C.to_half(F.col("x")).alias("h")).orderBy("i").collect()
    want = np.clip(np.array(x), -65504, 65504).astype(np.float16).astype(float)
    assert [r["h"] for r in got] == want.tolist()
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("-inf"),)], "x double").select(C.to_half(F.col("x")).alias("h")).collect()
    assert odd[0]["h"] is None and np.isnan(odd[1]["h"]) and odd[2]["h"] == -65504


def test_verdicts(spark):
    rows = [(1.0, 1.02, "approx", "PASS"), (1.0, 1.03, "approx", "FAIL"), (1.0, 1.0, "gt", "FAIL"), (1.0, 1.0, "ge", "PASS"), (1.0, 1.1, "le", "FAIL"), (None, 1.0, "ge", "MISSING"), (1.0, float("nan"), "le", "MISSING")]
    df = spark.createDataFrame(rows, "a double, b double, m string, want string").withColumn("got", C.verdict(F.col("a"), F.col("b"), F.col("m"), F.lit(0.02), F.lit(1e-9)))
    assert df.where("got <> want").count() == 0


def test_bed_by_label(spark):
    path = tempfile.mkdtemp(dir="/tmp", prefix="spark-") + "/bed"
    text.write_bed(spark.createDataFrame([("c", 1, None, "a"), ("d", 2, 3, "b")], "chrom string, start long, end long, label string"), path, "label")
    assert sorted((r["label"], r["value"]) for r in spark.read.text(path).collect()) == [("a", "c\t1\t."), ("all", "c\t1\t."), ("all", "d\t2\t3"), ("b", "d\t2\t3")]


def test_fields_by_name_or_place(spark):
    path = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    with open(f"{path}/a.tsv", "w") as f:
        f.write("! note\nx\tTarget\n1\tT1\n2\n\n")
    with open(f"{path}/b.tsv", "w") as f:
        f.write("1\t2\tT2\n1\t2\n")
    got = text.named_or_placed(spark, path, "Target", 2).collect()
    assert sorted((r["file"][-5:], r["value"]) for r in got) == [("a.tsv", "T1"), ("b.tsv", "T2")]
