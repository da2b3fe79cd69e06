"""Connected components of an edge table, without bringing links or components to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, cut, gathered, tidy


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots of links are hung below smaller ones until each link has one root, the smallest node of its component."""
    links = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if links:
        u, v = (np.concatenate(c) for c in zip(*links))
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(nodes))
        while len(a):
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
            a, b = a[a != b], b[a != b]
        yield pa.record_batch([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of edges(u, v): component is the smallest node that links reach.

    A small graph (common.FEW links at most) is one task's. Others alternate large-star and small-star (each node points its
    larger, then its smaller-or-equal neighbours at the smallest one), which halves paths and flattens chains, so rounds grow with the logarithm of the graph. A hub's
    minimum is a partial aggregate, and no row holds its neighbours; the join that brings the minimum back to them goes by
    the hub, and adaptive execution splits it where that is skewed. Nulls and loops go.
    """
    pairs = gathered(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if pairs.rdd.getNumPartitions() == 1 and pairs.count() <= FEW:
        return pairs.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(tidy(_few), "node long, component long").coalesce(1)
    mark = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").union(low.select(F.col("u").alias("x"), "m"))
        pairs = cut(small.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())
