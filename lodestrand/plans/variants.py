"""Queries of matched negatives, their benchmark, and trees, over the tables.

A variant is a line item: chromosome l_suppkey % 25, place l_partkey, alleles l_returnflag and l_linestatus; a gene is a
supplier, which starts at a multiple of its number. A positive is a seventh line within 400 of its supplier's start.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, trees
from ..operators import metrics as M
from .inventory import Tables, both


def genes(t: Tables):
    return t.supplier.select(F.col("s_suppkey").alias("gene"), (F.col("s_suppkey") % 25).alias("chrom"), (F.col("s_suppkey") * 37 % 2000).alias("tss"))


def variants(t: Tables):
    return t.lineitem.select((F.col("l_suppkey") % 25).alias("chrom"), F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("ref"), F.col("l_linestatus").alias("alt"), F.col("l_suppkey").alias("gene"), "l_linenumber")


def positives(t: Tables):
    """One row for each place, alleles and gene, which are its name."""
    near = variants(t).where("l_linenumber = 7").join(genes(t).select("gene", "tss"), "gene").where(F.abs(F.col("pos") - F.col("tss")) <= 400)
    key = ["chrom", "pos", "ref", "alt", "gene"]
    return near.select(*key).distinct().withColumn("id", F.concat_ws(":", *key))


def benchmark(t: Tables):
    """The area under the curves of a score of variants and genes, positives against each set of negatives."""
    rows = matching.negative_sets(positives(t), variants(t), genes(t), 2).where(F.col("neg_gene").isNotNull())
    score = lambda pos, gene: ((F.col(pos) * 31 + F.col(gene) * 7) % 997).cast("double")
    parts = [rows.select("set", F.lit(label).alias("label"), score(pos, gene).alias("score")) for label, pos, gene in ((1, "pos", "gene"), (0, "neg_pos", "neg_gene"))]
    return M.roc_pr(parts[0].union(parts[1]), ["set"]).select("set", "n", F.round("auroc", 8).alias("auroc"), F.round("auprc", 8).alias("auprc"))


both("j20_j21_distance_matched", lambda t: matching.distance_matched(positives(t), variants(t), genes(t)).select("id", "distance", *matching.NEGATIVE))
both("j21_m1_m2_variant_benchmark", benchmark)
both(
    "a41_tree_predicates",
    lambda t: trees.tree_predicates(t.part.select(F.lit(1).alias("tree"), F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") - 1 - F.col("p_size") % 7 >= 0, F.col("p_partkey") - 1 - F.col("p_size") % 7).alias("parent"), (F.col("p_brand") != "Brand#2").alias("marked"), F.sqrt("p_retailprice").alias("value")))
    .select("node", "depth", "leaves", "marked", "all_marked", "any_marked", F.round("mean", 6).alias("mean")),
    "WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey - 1 - p_size % 7 >= 0 THEN p_partkey - 1 - p_size % 7 END AS parent, p_brand <> 'Brand#2' AS marked, sqrt(p_retailprice) AS value FROM part), "
    "c AS (SELECT parent AS node, count(*) AS k FROM n WHERE parent IS NOT NULL GROUP BY 1), "
    "up(leaf, node, w) AS (SELECT node, node, 1.0::DOUBLE FROM n WHERE node NOT IN (SELECT node FROM c) UNION ALL SELECT up.leaf, n.parent, up.w / c.k FROM up JOIN n ON up.node = n.node JOIN c ON c.node = n.parent), "
    "d(node, depth) AS (SELECT node, 0::BIGINT FROM n WHERE parent IS NULL UNION ALL SELECT n.node, d.depth + 1 FROM n JOIN d ON n.parent = d.node) "
    "SELECT up.node, any_value(d.depth) AS depth, count(*) AS leaves, count(*) FILTER (l.marked) AS marked, bool_and(l.marked) AS all_marked, bool_or(l.marked) AS any_marked, round(sum(up.w * l.value), 6) AS mean "
    "FROM up JOIN n l ON up.leaf = l.node JOIN d ON d.node = up.node GROUP BY up.node",
)
