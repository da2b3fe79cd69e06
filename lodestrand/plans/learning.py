"""Queries of clusters and classifiers over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import clusters, learn
from .inventory import Tables, both


def vectors(t: Tables):
    return t.embeddings.where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("x"))


both(
    "m22_silhouettes", lambda t: clusters.silhouettes(vectors(t)).select(F.col("id").alias("vec_id"), "label", F.round("silhouette", 8).alias("silhouette")),
    "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.e, b.e)) AS s, count(*) AS n FROM v a JOIN v b ON true GROUP BY 1, 2, 3), "
    "m AS (SELECT vec_id, label, max(CASE WHEN other = label AND n > 1 THEN s / (n - 1) END) AS a, max(CASE WHEN other = label THEN n END) AS n, min(CASE WHEN other <> label THEN s / n END) AS b FROM d GROUP BY 1, 2) "
    "SELECT vec_id, label, round(CASE WHEN b IS NULL THEN NULL WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 8) AS silhouette FROM m",
)
both("m22_kmeans", lambda t: clusters.kmeans(vectors(t), 5, 25).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum(F.col("distance") * F.col("distance")), 6).alias("inertia")))


def suppliers(t: Tables):
    """Suppliers as points: what they sell on average."""
    own = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(C.exact_avg(F.col("l_quantity")).alias("q"), (C.exact_avg(F.col("l_extendedprice")) / 1000).alias("p"), (C.exact_avg(F.col("l_discount")) * 100).alias("d"))
    return own.select("id", F.array("q", "p", "d").alias("x"))


both("m23_ward", lambda t: clusters.linkage(suppliers(t)).select("a", "b", F.round("height", 6).alias("height"), "size"))
both("m23_average", lambda t: clusters.linkage(suppliers(t), "average").select("a", "b", F.round("height", 6).alias("height"), "size"))


def returned(t: Tables):
    """Whether a line item was returned, by its price, quantity and discount."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return t.lineitem.select(key.alias("id"), (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_quantity").cast("double") / 50).alias("quantity"), (F.col("l_extendedprice").cast("double") / 1e5).alias("price"), F.col("l_tax").cast("double").alias("tax"))


both("m16_cross_validated_auc", lambda t: learn.cross_validated_auc(returned(t), ["quantity", "price", "tax"], "label", "id").select("fold", "n", F.round("auroc", 8).alias("auroc")))
