"""What lies below each node of a tree, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import forget, kept

#: Rounds after which the parents must be a circle: trees are less than 2 ** ROUNDS deep.
ROUNDS = 40


def tree_predicates(nodes: DataFrame) -> DataFrame:
    """(tree, node, depth, leaves, marked, all_marked, any_marked, mean) for each of nodes(tree, node, parent, marked, value).

    leaves: how many leaves lie at or below the node, marked: how many of them are marked; mean: a leaf's value, or the
    mean of the children's means. A node without a parent, or whose parent isn't there, is a root of depth 0. A null mark
    counts as none, a null value as 0; rows without tree or node are left out. Nodes must be unique in their tree.

    Round k adds to each node what nodes exactly 2 ** k below it have gathered, and doubles their pointers, so a chain of
    n nodes takes log2(n) rounds of a join and a sum, and no node meets all its ancestors.
    """
    rows = nodes.where(F.col("tree").isNotNull() & F.col("node").isNotNull()).select("tree", "node", "parent", F.coalesce("marked", F.lit(False)).alias("marked"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    children = rows.where(F.col("parent").isNotNull()).groupBy("tree", F.col("parent").alias("jump")).agg(F.count("*").alias("siblings"))
    there = children.join(rows.select("tree", F.col("node").alias("jump")), ["tree", "jump"], "left_semi")
    inner = children.select("tree", F.col("jump").alias("node"), F.lit(True).alias("inner"))
    leaf = F.col("inner").isNull()
    state = rows.join(inner, ["tree", "node"], "left").join(there.withColumnRenamed("jump", "parent"), ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("siblings").isNotNull(), F.col("parent")).alias("jump"), (1 / F.col("siblings")).alias("weight"), F.when(F.col("siblings").isNotNull(), 1).otherwise(0).cast("long").alias("depth"),
        leaf.cast("long").alias("leaves"), (leaf & F.col("marked")).cast("long").alias("marked"), F.when(leaf, F.col("value")).otherwise(0.0).alias("mean"),
    )
    state = kept(state)
    for _ in range(ROUNDS):
        moving = state.where(F.col("jump").isNotNull())
        if moving.isEmpty():
            break
        below = moving.groupBy("tree", F.col("jump").alias("node")).agg(F.sum("leaves").alias("l"), F.sum("marked").alias("m"), F.sum(F.col("weight") * F.col("mean")).alias("v"))
        over = state.select("tree", F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("weight").alias("w"), F.col("depth").alias("d"))
        more = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
        new = kept(state.join(below, ["tree", "node"], "left").join(over, ["tree", "jump"], "left").select("tree", "node", F.col("next").alias("jump"), (F.col("weight") * F.col("w")).alias("weight"), more("depth", "d"), more("leaves", "l"), more("marked", "m"), more("mean", "v")))
        forget(state)
        state = new
    else:
        raise ValueError("the parents of some tree form a circle")
    return state.select("tree", "node", "depth", "leaves", "marked", (F.col("marked") == F.col("leaves")).alias("all_marked"), (F.col("marked") > 0).alias("any_marked"), "mean")
