"""Inventory queries over the whole of their inputs, and ranks against brute force."""

import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestrand.functions import columns
from lodestrand.operators import windows
from lodestrand.plans import inventory, more  # noqa: F401

SF = "/root/testdata/sf0.001"
INTERVALS = sorted(k for k, v in inventory.ORACLES.items() if v.startswith(f"WITH {inventory.PEAKS}"))


def rows(columns, values):
    return Counter(tuple(round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in (dict(zip(columns, r))[c] for c in sorted(columns))) for r in values)


def whole(sql):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    out = con.execute(sql)
    return rows([d[0] for d in out.description], out.fetchall())


def test_interval_queries_are_found():
    assert {
        "j10_overlap_join", "j11_closed_overlap", "j12_overlap_flag", "j13_not_overlapping", "j14_window_counts", "j15_overlapping_ids", "j16_containment", "j17_intersect", "j18_subtract", "j19_nearest",
        "j20_distance_band", "j28_peak_mask", "a14_merge", "a15_base_jaccard", "a16_bin_confusion", "a36_coverage", "w8_complement",
    } <= set(INTERVALS)


@pytest.mark.parametrize("name", INTERVALS)
def test_intervals_read_every_peak(spark, name):
    df = inventory.QUERIES[name](spark, SF)
    assert rows(df.columns, df.collect()) == whole(inventory.ORACLES[name])


@pytest.mark.parametrize("name", ["q1_reverse_complement", "q2_one_hot"])
def test_texts_are_whole(spark, name):
    df = inventory.QUERIES[name](spark, SF)
    assert rows(df.columns, df.collect()) == whole(inventory.ORACLES[name])


def test_positional_join_has_every_position(spark):
    df = inventory.QUERIES["j22_positional_join"](spark, SF)
    assert df.count() == 64
    assert rows(df.columns, df.collect()) == whole(inventory.ORACLES["j22_positional_join"])


def test_mutants(spark):
    texts = [(1, "the quick brown fox, and Ünder the line" * 3), (2, "eta"), (3, ""), (4, None), (5, "xyz"), (6, "e")]
    dna = [(i, None if t is None else t.translate(str.maketrans("etaoinshrdluETAOINSHRDLU", "ACGT" * 6))) for i, t in texts]
    want = Counter((i, k, c, b, s[:k] + b + s[k + 1 :]) for i, s in dna for k, c in enumerate(s or "") if c in "ACGT" for b in "ACGT" if b != c)
    got = columns.single_mutants(spark.createDataFrame(dna, "doc_id long, s string"), "s")
    assert Counter(tuple(r) for r in got.select("doc_id", "pos", "ref", "alt", "mutant").collect()) == want


def test_ranks_in_blocks(spark):
    """Ranks, percentiles and hash ranks of a group with nearly all rows, many ties and a few rows elsewhere."""
    rnd = random.Random(9)
    rows = [("a", float(rnd.choice((0, 1, 1, 2, rnd.randrange(400)))), i) for i in range(3000)] + [("b", 5.0, 3000), ("c", 1.0, 3001), ("c", 1.0, 3002)]
    df = spark.createDataFrame(rows, "g string, v double, i long")
    own = {g: sorted((v, i) for h, v, i in rows if h == g) for g in "abc"}
    first = {i: (k + 1) / len(x) for x in own.values() for k, (_, i) in enumerate(x)}
    high = {i: sum(w <= v for w, _ in x) / len(x) for x in own.values() for v, i in x}
    mean = {i: (sum(w < v for w, _ in x) * 2 + sum(w == v for w, _ in x) + 1) / 2 for x in own.values() for v, i in x}
    for made, want in ((windows.pct_rank_first(df, ["g"], "v", "i"), first), (windows.pct_rank_max(df, ["g"], "v"), high), (windows.average_rank(df, ["g"], "v", "rank"), mean)):
        assert {r["i"]: r["rank"] for r in made.collect()} == want
    got = {r["g"]: (r["p"], r["q"]) for r in windows.percentiles(df, ["g"], "v", {"p": 0.5, "q": 0.93}).collect()}
    assert all(got[g] == pytest.approx(tuple(np.percentile([v for v, _ in x], (50, 93)))) for g, x in own.items())
    ranks = sorted((r["g"], r["rank"]) for r in windows.hash_ranked(df, ["g"], "i").collect())
    assert ranks == sorted((g, k + 1) for g, x in own.items() for k in range(len(x)))
