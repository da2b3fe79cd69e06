"""Inventory queries against DuckDB over the smallest tables, and operators against brute force."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrand.functions import columns as C
from lodestrand.operators import intervals, metrics
from lodestrand.plans import files, inventory, learning, more, variants  # noqa: F401
from lodestrand.sources import text

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(inventory.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = inventory.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    out = duck.execute(inventory.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(float(r[names.index(c)]) if type(r[names.index(c)]).__name__ == "Decimal" else r[names.index(c)]) for c in columns) for r in out.fetchall()), key=repr)
    assert got == want


def test_overlap_join_edges(spark):
    rnd = random.Random(5)
    rows = lambda n: [(rnd.choice("ab"), s := rnd.randrange(60), s + rnd.choice((0, 1, 3, 25)), i) for i in range(n)]
    a, b = rows(40) + [("a", 5, 5, 99)], rows(40)
    left, right = (spark.createDataFrame(x, "chrom string, start long, end long, id long") for x in (a, b))
    for closed in (False, True):
        more = 0 if closed else 1
        ok = lambda x, y: x[0] == y[0] and x[1] <= x[2] - more and y[1] <= y[2] - more and x[1] <= y[2] - more and y[1] <= x[2] - more
        got = sorted(tuple(r) for r in intervals.overlap_join(left, right, 7, closed).select("id", "id_b").collect())
        assert got == sorted((x[3], y[3]) for x in a for y in b if ok(x, y))


def test_nearest_takes_left_of_ties(spark):
    q = spark.createDataFrame([("a", 10, 1), ("a", 5, 2), ("b", 1, 3)], "chrom string, pos long, id long")
    p = spark.createDataFrame([("a", 8), ("a", 12), ("a", 5)], "chrom string, point long")
    got = {r["id"]: (r["point"], r["distance"]) for r in intervals.nearest(q, p).collect()}
    assert got == {1: (8, -2), 2: (5, 0), 3: (None, None)}


def test_auroc_counts_pairs(spark):
    rnd = random.Random(3)
    rows = [("x", rnd.random() < 0.4, float(rnd.randrange(8))) for _ in range(80)]
    df = spark.createDataFrame([(g, int(b), s) for g, b, s in rows], "g string, label int, score double")
    pairs = [(1.0 if p[2] > q[2] else 0.5 if p[2] == q[2] else 0.0) for p in rows if p[1] for q in rows if not q[1]]
    assert metrics.roc_pr(df, ["g"]).first()["auroc"] == pytest.approx(sum(pairs) / len(pairs))


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('# c\nI\ts\tgene\t11\t20\t.\t+\t.\tgene_id "g1"; name "n"; gene_id "g2";\nshort\n')
    row = text.gtf(text.lines(spark, str(tmp_path / "a.gtf")), zero_based=True).first()
    assert (row["start"], row["end"], row["attrs"]) == (10, 20, {"name": "n", "gene_id": "g2"})
    (tmp_path / "a.fa").write_text(">chrI a>b\nACGT\nac\n>chrII\nNN\n")
    assert sorted(tuple(r) for r in text.fasta(spark, str(tmp_path / "a.fa")).select("id", "seq").collect()) == [("chrI", "ACGTac"), ("chrII", "NN")]
    (tmp_path / "a.vcf").write_text("##x\nchrI\t5\t.\tA\tC,G\t1\tPASS\tAC=3;AN=6\n")
    row = text.vcf(text.lines(spark, str(tmp_path / "a.vcf"))).select("alleles", text.allele_frequency(F.col("info")).alias("af")).first()
    assert (row["alleles"], row["af"]) == (["C", "G"], 0.5)
    assert text.newick_edges("((A:1,B:2)C:0.5,D);") == [(0, -1, "", None), (1, 0, "C", 0.5), (2, 1, "A", 1.0), (3, 1, "B", 2.0), (4, 0, "D", None)]


def test_columns(spark):
    df = spark.createDataFrame([("ACGTn", "1"), ("aaN", "chromosome16"), ("", "Mito")], "s string, c string")
    got = df.select(C.reverse_complement(F.col("s")).alias("rc"), C.canonical_chromosome(F.col("c")).alias("c"), C.fetch(F.col("s"), F.lit(-2), F.lit(4)).alias("f")).collect()
    assert [tuple(r) for r in got] == [("nACGT", "chrI", "NNACGT"), ("Ntt", "chrXVI", "NNaaNN"), ("", "Mito", "NNNNNN")]


@pytest.mark.parametrize("name", ["j5_j8_anti_join", "u4_except", "f13_fraction_windows", "j25_substring_lookup", "q3_q12_round_trip"])
def test_rows_stay_and_rows_go(spark, name):
    """Each keeps some of its table's rows at the size at which it is compared, and not all."""
    sf = "/root/testdata/sf0.01"
    whole = {"j5_j8_anti_join": "customer", "u4_except": "part", "f13_fraction_windows": "lineitem", "j25_substring_lookup": "part", "q3_q12_round_trip": "documents"}[name]
    kept = inventory.QUERIES[name](spark, sf).count()
    assert 0 < kept and (kept < spark.read.parquet(f"{sf}/{whole}.parquet").count() or name == "q3_q12_round_trip")
