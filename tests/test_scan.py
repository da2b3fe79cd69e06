"""Two-level scans against plain loops, with one group that holds most rows, ties, nulls and blocks of every size."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import intervals, metrics, scan, tracks, windows


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    groups = ["big"] * 18 + ["small", None]
    return [(rnd.choice(groups), rnd.choice([None, *range(0, 400)]) if rnd.random() < 0.02 else rnd.randrange(400), i, rnd.choice([None, 1, 2, 5])) for i in range(1500)]


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
def test_scan(spark, rows, width):
    df = spark.createDataFrame(rows, "g string, at int, tie int, v int").repartition(3)
    v = F.col("v")
    out = scan.scan(df, ["g"], "at", {"s": ("sum", v), "m": ("max", v), "l": ("last", v), "n": ("next", v)}, (F.col("tie"),), width).collect()
    got = {r["tie"]: (r["s"], r["m"], r["l"], r["n"]) for r in out}
    assert len(out) == len(rows)
    for g in ("big", "small", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-1 if r[1] is None else r[1], r[2]))
        for i, r in enumerate(own):
            before, after = [x[3] for x in own[:i] if x[3] is not None], [x[3] for x in own[i + 1 :] if x[3] is not None]
            assert got[r[2]] == (sum(before), max(before, default=None), before[-1] if before else None, after[0] if after else None)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    rnd = random.Random(3)
    rows = [(g, float(x), rnd.randrange(9)) for g, n in (("big", 900), ("one", 1), (None, 40)) for x in rnd.sample(range(5000), n)]
    df = spark.createDataFrame(rows, "g string, x double, c int").repartition(4)
    got = {(r["g"], r["x"]): r["s"] for r in scan.running_sums(df, ["g"], "x", {"s": "c"}, descending).collect()}
    assert got == {(g, x): sum(c for h, y, c in rows if h == g and (y > x if descending else y < x)) for g, x, _ in rows}


def spans(n):
    rnd = random.Random(n)
    return [("c" if rnd.random() < 0.9 else "d", s := rnd.randrange(20_000), s + rnd.choice([1, 3, 40, 9000 if rnd.random() < 0.01 else 2])) for _ in range(n)]


def test_intervals_across_blocks(spark):
    """Positions of several blocks and spans longer than one, nine tenths on one chromosome."""
    a, b = spans(700), spans(701)
    left, right = (spark.createDataFrame(x, "chrom string, start long, end long").repartition(4) for x in (a, b))
    depth = {c: [[0, 0] for _ in range(30_000)] for c in "cd"}
    for side, all_ in enumerate((a, b)):
        for c, s, e in all_:
            for x in range(s, e):
                depth[c][x][side] += 1
    runs = lambda f: sorted((c, s, e, v) for c in "cd" for s, e, v in _runs([f(x) for x in depth[c]]))
    merged, touching = [], sorted(a)
    for c, s, e in touching:
        if merged and merged[-1][0] == c and s <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([c, s, e])
    assert sorted(tuple(r) for r in intervals.merged(left).select("chrom", "start", "end").collect()) == sorted(map(tuple, merged))
    flat = lambda df: sorted((r["chrom"], x, r["depth"]) for r in df.collect() for x in range(r["start"], r["end"]))
    assert flat(intervals.coverage(left)) == sorted((c, x, depth[c][x][0]) for c in "cd" for x in range(30_000) if depth[c][x][0])
    both = tracks.breakpoints(left, right).collect()
    assert sorted((r["chrom"], x, r["a"], r["b"]) for r in both for x in range(r["start"], r["end"])) == sorted((c, x, *depth[c][x]) for c in "cd" for x in range(30_000) if any(depth[c][x]))
    sizes = spark.createDataFrame([("c", 30_000), ("d", 30_000)], "chrom string, size long")
    gaps = [(c, s, e) for c, s, e, v in runs(lambda x: x[0] > 0) if not v]
    assert sorted(tuple(r) for r in intervals.complement(left, sizes).collect()) == gaps
    mids = spark.createDataFrame([(c, s) for c, s, _ in a], "chrom string, mid long")
    for width in (1, 50, 6000):
        want = {k: max(sum(c == k and m <= y < m + width for c, y, _ in a) for m in {s for c, s, _ in a if c == k}) for k in "cd"}
        assert {r["chrom"]: r["most"] for r in intervals.most_in_window(mids, width).collect()} == want
    q, p = [(c, s, i) for i, (c, s, _) in enumerate(a)], sorted({(c, s) for c, s, _ in b[:90]})
    near = intervals.nearest(spark.createDataFrame(q, "chrom string, pos long, id long"), spark.createDataFrame(p, "chrom string, point long")).collect()
    assert {r["id"]: r["point"] for r in near} == {i: min((x for k, x in p if k == c), key=lambda x: (abs(x - s), x), default=None) for c, s, i in q}


def _runs(values):
    s = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[s]:
            yield s, i, values[s]
            s = i


def test_no_window_over_a_whole_group(spark):
    """The rows are ordered within (group, block) only; what is ordered by group is a row for each block."""
    df = spark.createDataFrame([("c", 1, 2)], "chrom string, start long, end long")
    at = spark.createDataFrame([("g", 1, 0.5)], "g string, label int, score double")
    for made in (intervals.merged(df), intervals.coverage(df), tracks.breakpoints(df, df), metrics.roc_pr(at, ["g"]), metrics.mann_whitney(at, ["g"]), metrics.kolmogorov_smirnov(at, ["g"])):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and "__block" not in line.split("], [")[1]:
                assert "__in_" in line, line


def test_percentiles(spark):
    rnd = random.Random(6)
    rows = [(g, rnd.choice([None, float(rnd.randrange(50))])) for g in ["a"] * 500 + ["b"] * 3 + [None] * 20 for _ in (0,)]
    got = {r["g"]: (r["p"], r["q"]) for r in windows.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p": 0.5, "q": 0.9}).collect()}
    for g in ("a", "b", None):
        v = sorted(x for h, x in rows if h == g and x is not None)
        if v:
            for k, p in enumerate((0.5, 0.9)):
                at = p * (len(v) - 1)
                low = v[int(at)]
                assert abs(got[g][k] - (low + (at - int(at)) * (v[min(int(at) + 1, len(v) - 1)] - low))) < 1e-9
