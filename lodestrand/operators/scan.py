"""Ordered scans in two levels: rows are worked on by blocks of places or values, and what came before a block is carried to it.

A window over a whole group is one task for each group, however long. Here each (group, block) is a piece of work of its
own; the carries are a row for each block, and only they are ordered by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Positions of a block, and blocks that a group's values are cut into; rows of a group that is one block, and rows that
#: the edges of a larger one's blocks are read from, about.
WIDTH, BLOCKS, LEAST, SAMPLED = 4096, 64, 1024, 4096


def _keyed(df: DataFrame, by: list[str]) -> DataFrame:
    """With __key, which is never null, so that groups with a null in their name are kept by joins."""
    return df.withColumn("__key", F.struct(*by))


def in_blocks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with __block, by which a group's values go up: one block for up to LEAST rows, BLOCKS about equal ones for more.

    Edges are quantiles of those rows whose hash falls under the group's part of SAMPLED rows, so they depend on the rows
    alone. (Approximate quantiles of all rows depend on the order in which tasks end as well; a plan that makes them
    twice cut the rows in two ways, and carries were lost.) Only where a block ends depends on the sample, no result.
    """
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    part = F.pmod(F.xxhash64(*hashed), F.lit(1 << 40))
    large = df.groupBy(*by).agg(F.count("*").alias("__size")).where(F.col("__size") > LEAST)
    some = df.withColumn("__part", part).join(large, by).where(F.col("__part") < F.lit(float(SAMPLED << 40)) / F.col("__size"))
    points = [i / BLOCKS for i in range(1, BLOCKS)]
    if isinstance(df.schema[value].dataType, NumericType):
        ends = F.percentile(value, F.array(*map(F.lit, points)))
    else:
        met = F.array_sort(F.collect_set(value))
        ends = F.array(*(F.get(met, F.floor(F.size(met) * p).cast("int")) for p in points))
    edges = some.groupBy(*by).agg(F.array_distinct(ends).alias("__edges"))
    cut = df.join(edges, by, "left")
    return cut.withColumn("__block", F.coalesce(F.size(F.filter("__edges", lambda e: e < F.col(value))), F.lit(0))).drop("__edges")


def scan(df: DataFrame, by: list[str], place: str, carries: dict[str, tuple[str, Column]], ties: tuple[Column, ...] = (), width: int = WIDTH) -> DataFrame:
    """df with a column for each of carries over the group's other rows in order of `place`, then of ties.

    sum, max, last: of the rows before (0 and null if there are none, or none with a value); next: of the rows after.
    Rows with a null place come first, in a block of their own.
    """
    values = {name: f"__of_{name}" for name in carries}
    order = [F.col(place), *ties]
    rows = _keyed(df, by).withColumn("__block", F.coalesce(F.floor(F.col(place) / width), F.lit(-(1 << 62)))).withColumns({values[n]: v for n, (_, v) in carries.items()})
    at = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    parts, before = [], []
    up = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("__key").orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, _) in carries.items():
        v = F.col(values[name])
        known = F.when(v.isNotNull(), at)
        parts.append({"sum": F.sum(v), "max": F.max(v), "last": F.max_by(v, known), "next": F.min_by(v, known)}[kind].alias(f"__in_{name}"))
        own = F.col(f"__in_{name}")
        before.append({"sum": lambda c: F.sum(c).over(up), "max": lambda c: F.max(c).over(up), "last": lambda c: F.last(c, True).over(up), "next": lambda c: F.last(c, True).over(down)}[kind](own).alias(f"__to_{name}"))
    carried = rows.groupBy("__key", "__block").agg(*parts).select("__key", "__block", *before)
    both = rows.join(carried, ["__key", "__block"])
    inside = Window.partitionBy("__key", "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("__key", "__block").orderBy(*(c.desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for name, (kind, _) in carries.items():
        v, to = F.col(values[name]), F.col(f"__to_{name}")
        if kind == "sum":
            out[name] = F.coalesce(to, F.lit(0)) + F.coalesce(F.sum(v).over(inside), F.lit(0))
        elif kind == "max":
            out[name] = F.greatest(to, F.max(v).over(inside))
        else:
            out[name] = F.coalesce(F.last(v, True).over(inside if kind == "last" else back), to)
    return both.withColumns(out).drop("__key", "__block", *values.values(), *(f"__to_{n}" for n in carries))


def running_sums(df: DataFrame, by: list[str], value: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """df, whose values are unique in their group, with sums (new column: column) over the group's rows of lower values, or higher ones.

    Blocks lie between quantiles of a sample of a group's values.
    """
    cut = in_blocks(_keyed(df, by), ["__key"], value)
    turned = (lambda c: F.desc(c)) if descending else F.col
    up = Window.partitionBy("__key").orderBy(turned("__block")).rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("__key", "__block").agg(*(F.sum(c).alias(f"__in_{n}") for n, c in sums.items()))
    parts = parts.select("__key", "__block", *(F.coalesce(F.sum(f"__in_{n}").over(up), F.lit(0)).alias(f"__to_{n}") for n in sums))
    inside = Window.partitionBy("__key", "__block").orderBy(turned(value)).rowsBetween(Window.unboundedPreceding, -1)
    both = cut.join(parts, ["__key", "__block"])
    return both.withColumns({n: F.col(f"__to_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).drop("__key", "__block", *(f"__to_{n}" for n in sums))


def counted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, before): how many rows have the value, and a lower one; rows are counted before anything is ordered."""
    return running_sums(df.groupBy(*by, value).agg(F.count("*").alias("n")), by, value, {"before": "n"})
