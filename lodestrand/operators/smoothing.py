"""Smoothing of matrices that are tables of cells: each axis in a pass of its own, in blocks with halos."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of a line that a block holds, besides its halo.
BLOCK = 64


def _pass(cells: DataFrame, keys: Sequence[str], axis: str, size: str, weights: list[float]) -> DataFrame:
    """Weighted sums along one axis; a line's blocks get the cells up to a radius beyond them, mirrored at its ends."""
    r = len(weights) - 1
    n, at = F.col(size), F.col(axis)
    turns = F.sequence(-(F.floor(F.lit(r) / (2 * n)) + 1), F.floor(F.lit(r) / (2 * n)) + 1)
    images = F.flatten(F.transform(turns, lambda m: F.array(at + 2 * n * m, 2 * n * m - 1 - at)))
    images = F.filter(images, lambda p: (p >= -r) & (p < n + r))
    spread = cells.select(*keys, size, "v", F.explode(images).alias("p"))
    # a position is needed by the blocks that begin at most r after it and end at most r before it
    first, last = F.greatest(F.lit(0), F.floor((F.col("p") - r) / BLOCK)), F.least(F.floor((n - 1) / BLOCK), F.floor((F.col("p") + r) / BLOCK))
    spread = spread.select(*keys, size, F.struct("p", "v").alias("cell"), F.explode(F.sequence(first, last)).alias("block"))
    lines = spread.groupBy(*keys, size, "block").agg(F.collect_list("cell").alias("cells"))
    places = F.sequence(F.col("block") * BLOCK, F.least(n, (F.col("block") + 1) * BLOCK) - 1)
    fixed = F.array(*map(F.lit, weights))

    def place(q):
        near = F.filter("cells", lambda c: F.abs(c["p"] - q) <= r)
        return F.struct(q.alias(axis), F.when(F.size(near) > 0, F.aggregate(near, F.lit(0.0), lambda s, c: s + c["v"] * F.get(fixed, F.abs(c["p"] - q).cast("int")))).alias("v"))

    return lines.select(*keys, size, F.explode(F.transform(places, place)).alias("x")).select(*keys, size, f"x.{axis}", "x.v").where("v IS NOT NULL")


def gaussian(cells: DataFrame, keys: Sequence[str], sigma: float, truncate: float = 4.0) -> DataFrame:
    """cells(*keys, i, j, v) smoothed by a Gaussian of sigma, cut off at truncate * sigma and mirrored at the edges.

    A matrix is as large as its largest i and j tell. A cell that isn't there, or is null, counts as 0, and places with
    no cell in reach have no row. Cells of one place add up. Two shuffles, by line and block: no line, let alone a
    matrix, meets in one row.
    """
    r = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(r + 1)]
    weights = [w / (raw[0] + 2 * sum(raw[1:])) for w in raw]
    cells = cells.where("i IS NOT NULL AND j IS NOT NULL AND v IS NOT NULL").select(*keys, F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("double"))
    # null-safe: a null key is a matrix of its own
    sizes = cells.groupBy(*keys).agg((F.max("i") + 1).alias("n_i"), (F.max("j") + 1).alias("n_j"))
    sizes = sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), "n_i", "n_j")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    sized = cells.join(sizes, on).drop(*(f"_{k}" for k in keys))
    across = _pass(sized, [*keys, "i", "n_i"], "j", "n_j", weights)
    return _pass(across, [*keys, "j"], "i", "n_i", weights).select(*keys, "i", "j", "v")
