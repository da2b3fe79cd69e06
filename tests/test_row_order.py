"""Results that may not depend on the order in which rows, or tasks, come."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import scan, windows
from lodestrand.plans import inventory, more  # noqa: F401


def test_percentiles_of_many_groups(spark):
    """Groups whose rows come from many tasks; what cuts them in blocks is made twice in the plan, so it may not be approximate."""
    rows = spark.range(0, 180_000, 1, 6).select((F.col("id") % 60).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(9_000_000)) / 100).alias("v"))
    found = windows.percentiles(rows, ["g"], "v", {"p": 0.5})
    assert "percentile_approx" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["g"]: r["p"] for r in found.collect()}
    own = rows.toArrow()
    g, v = own["g"].to_numpy(), own["v"].to_numpy()
    want = np.median(v[np.lexsort((v, g))].reshape(60, -1), axis=1)
    assert [got[k] for k in range(60)] == pytest.approx(want.tolist(), rel=1e-12)


@pytest.mark.parametrize("kind", ["long", "timestamp"])
def test_blocks_depend_on_rows_alone(spark, kind):
    rows = spark.range(30_000).select((F.col("id") % 3 % 2).alias("g"), F.when(F.col("id") % 5 < 4, F.pmod(F.xxhash64("id"), F.lit(1 << 30))).otherwise(7).cast(kind).alias("v"), "id")
    cut = [scan.in_blocks(rows.repartition(n, c), ["g"], "v").select("id", "__block", "v", "g") for n, c in ((2, "id"), (9, "v"))]
    one, two = ({r["id"]: r["__block"] for r in df.collect()} for df in cut)
    assert one == two
    sizes = cut[0].groupBy("g", "__block").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("g", "__block").collect()
    assert len(sizes) > 60 and all(a["high"] < b["low"] for a, b in zip(sizes, sizes[1:]) if a["g"] == b["g"])


LINES = "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_discount double, l_tax double, l_extendedprice double, l_returnflag string"


def lines(spark, path, rows):
    """A lineitem of (supplier, line, discount, price), in this order in one file."""
    own = [(i, n, k, 1, d, 0.0, p, "R") for i, (k, n, d, p) in enumerate(rows)]
    spark.createDataFrame(own, LINES).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_ranks_of_equal_means(spark, tmp_path):
    """Two genes of equal prices in two orders have equal means: the first gene comes first."""
    prices = {1: [0.1, 0.2, 0.3], 2: [0.3, 0.2, 0.1]}
    sf = lines(spark, tmp_path, [(g, 1, 0.0, p) for g in prices for p in prices[g]] + [(1, 2, 0.0, 5.0), (2, 2, 0.0, 9.0)])
    got = {(r["gene"], r["track"]): r["v"] for r in inventory.QUERIES["m17_quantile_normalised"](spark, sf).collect()}
    assert got == {(g, n): 0.0 for g in (1, 2) for n in (1, 2)}  # both tracks rank gene 1 before gene 2


def test_trim_bounds_of_equal_weights(spark, tmp_path):
    """Ten tenths are one, which is 0.8 of the top of 1.25, in whatever order they are added up."""
    sf = lines(spark, tmp_path, [(1, 1, 0.1, 1.0)] * 10 + [(1, 4, 1.25, 1.0)] + [(1, n, 0.0, 1.0) for n in (2, 3, 5, 6)])
    row = inventory.QUERIES["a38_trim_bounds"](spark, sf).first()
    assert (row["trim_start"], row["trim_end"], row["size"]) == (0, 5, 6)
    assert inventory.QUERIES["a39_confidence"](spark, sf).first()["confidence"] == 2.25
    placed = inventory.QUERIES["c27_seqlet_place"](spark, sf).where("l_linenumber = 4").first()
    assert (placed["start"], placed["end"]) == (6, 11)
