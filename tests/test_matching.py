"""Matched negatives against their definition, and trees against walks."""

import random

import pytest

from lodestrand.operators import matching, trees
from lodestrand.sources.text import newick_edges

SCHEMA = "id long, chrom string, pos long, ref string, alt string, gene string"


def check(positives, variants, genes, rows, tolerance, wide):
    """Every condition on the negatives, and that no positive without one (or with a far one) has a free pair left."""
    tss = {g: (c, s) for g, c, s in genes}
    taken_variants = {p[1:5] for p in positives}
    triples = {(p[1], p[2], p[5]) for p in positives}
    got = {r["id"]: r for r in rows}
    assert sorted(got) == sorted(p[0] for p in positives)
    used = [(r["neg_chrom"], r["neg_pos"], r["neg_gene"]) for r in rows if r["neg_gene"] is not None]
    assert len(used) == len(set(used)) and not set(used) & triples
    free = [(c, p, a, b, g, abs(p - s)) for c, p, a, b in set(variants) - taken_variants if None not in (c, p, a, b) for g, (k, s) in tss.items() if k == c and (c, p, g) not in triples and (c, p, g) not in used]
    for i, c, p, a, b, g in positives:
        r = got[i]
        d = abs(p - tss[g][1]) if g in tss and p is not None else None
        assert r["distance"] == d
        if r["neg_gene"] is not None:
            assert any((r["neg_chrom"], r["neg_pos"], a, b) == v for v in set(variants) - taken_variants)
            assert tss[r["neg_gene"]][0] == r["neg_chrom"] and abs(r["neg_pos"] - tss[r["neg_gene"]][1]) == r["neg_distance"] and abs(r["neg_distance"] - d) <= wide
        elif d is not None and a is not None and b is not None:
            assert not any((x[2], x[3]) == (a, b) and abs(x[5] - d) <= wide for x in free)
        if r["neg_gene"] is not None and abs(r["neg_distance"] - d) > tolerance:
            assert not any((x[2], x[3]) == (a, b) and abs(x[5] - d) <= tolerance for x in free)
    return len(used)


def frames(spark, positives, variants, genes):
    return spark.createDataFrame(positives, SCHEMA), spark.createDataFrame(variants, "chrom string, pos long, ref string, alt string"), spark.createDataFrame(genes, "gene string, chrom string, tss long")


def test_negatives(spark):
    rnd = random.Random(5)
    genes = [(f"g{i}", rnd.choice("xyz"), rnd.randrange(300)) for i in range(12)]
    letters = ["A"] * 6 + ["C"]  # one pair of alleles has most rows
    variants = [(rnd.choice("xyz"), rnd.randrange(300), rnd.choice(letters), rnd.choice("GT")) for _ in range(160)]
    positives = [(i, *rnd.choice(variants), rnd.choice(genes)[0]) for i in range(60)]
    positives += [(100, "x", 5, "A", "G", "nowhere"), (101, "x", None, "A", "G", "g1"), (102, "x", 7, None, "G", "g1"), (103, *positives[0][1:])]
    rows = matching.distance_matched(*frames(spark, positives, variants + [("x", None, "A", "G")], genes), 3, 20).collect()
    assert check(positives, variants, genes, rows, 3, 20) > 20
    again = matching.distance_matched(*(f.repartition(3) for f in frames(spark, positives, variants, genes)), 3, 20).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_more_positives_than_negatives(spark):
    """All positives want one distance, so all ask for the same values; one place has two alternatives, of which one may be used."""
    genes = [("g", "x", 0), ("h", "y", 0)]
    variants = [("y", 50 + k, "A", "G") for k in range(4)] + [("y", 50, "A", "T"), ("y", 90, "A", "G")]
    positives = [(i, "x", 50, "A", "G" if i < 9 else "T", "g") for i in range(10)]
    rows = matching.distance_matched(*frames(spark, positives, variants, genes), 1, 5).collect()
    assert check(positives, variants, genes, rows, 1, 5) == 4
    none = matching.distance_matched(*frames(spark, [], variants, genes))
    assert none.count() == 0 and set(matching.NEGATIVE) <= set(none.columns)
    assert all(r["neg_gene"] is None for r in matching.distance_matched(*frames(spark, positives, [], genes)).collect())


def walked(nodes):
    """The same by recursion from the roots."""
    below, out = {}, {}
    names = {n[0] for n in nodes}
    for n in nodes:
        below.setdefault(n[1] if n[1] in names else None, []).append(n)
    stack = [(n, 0, False) for n in below.get(None, [])]
    while stack:
        n, depth, done = stack.pop()
        children = below.get(n[0], [])
        if not children:
            out[n[0]] = (depth, 1, int(bool(n[2])), n[3] or 0.0)
        elif done:
            parts = [out[c[0]] for c in children]
            out[n[0]] = (depth, sum(p[1] for p in parts), sum(p[2] for p in parts), sum(p[3] for p in parts) / len(parts))
        else:
            stack += [(n, depth, True), *((c, depth + 1, False) for c in children)]
    return out


@pytest.mark.parametrize("shape", ["random", "chain", "star", "newick"])
def test_trees(spark, shape):
    rnd = random.Random(3)
    parent = {"random": lambda i: rnd.randrange(i), "chain": lambda i: i - 1, "star": lambda i: 0}
    if shape == "newick":
        edges = [(n, p) for n, p, *_ in newick_edges("((a,b)x,(c,(d,e,f)),g);")]
    else:
        edges = [(0, None)] + [(i, parent[shape](i)) for i in range(1, 120)] + [(500, 999), (501, 500)]
    nodes = [(i, p, rnd.choice([True, True, False, None]), rnd.choice([None, rnd.random()])) for i, p in edges]
    df = spark.createDataFrame([("t", *n) for n in nodes] + [(None, 1, 0, True, 1.0), ("t", None, 0, True, 1.0)], "tree string, node long, parent long, marked boolean, value double")
    # a row without a node is nobody's child
    rows = trees.tree_predicates(df).collect()
    want = walked(nodes)
    assert len(rows) == len(want)
    for r in rows:
        depth, leaves, marked, mean = want[r["node"]]
        assert (r["depth"], r["leaves"], r["marked"], r["all_marked"], r["any_marked"]) == (depth, leaves, marked, marked == leaves, marked > 0)
        assert abs(r["mean"] - mean) < 1e-9


def test_circle(spark):
    with pytest.raises(ValueError):
        trees.ROUNDS, most = 4, trees.ROUNDS
        try:
            trees.tree_predicates(spark.createDataFrame([(1, 1, 2, True, 0.0), (1, 2, 1, True, 0.0)], "tree int, node int, parent int, marked boolean, value double"))
        finally:
            trees.ROUNDS = most


def test_whole_table(spark):
    """The query's tables, checked as above."""
    from lodestrand.plans import inventory, variants

    t = inventory.Tables(spark, "/root/testdata/sf0.001")
    rows = lambda df, *names: [tuple(r[c] for c in names) for r in df.collect()]
    positives = rows(variants.positives(t), "id", "chrom", "pos", "ref", "alt", "gene")
    alleles = rows(variants.variants(t), "chrom", "pos", "ref", "alt")
    genes = rows(variants.genes(t), "gene", "chrom", "tss")
    got = matching.distance_matched(variants.positives(t), variants.variants(t), variants.genes(t))
    n = check(positives, alleles, genes, got.collect(), 10, 200)
    assert n and got.count() == len(positives)
