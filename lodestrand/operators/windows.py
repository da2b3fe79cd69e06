"""Ranks, moving averages, islands, sampling and table shaping with stated orders and ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .scan import counted, in_blocks


def pct_rank_max(df: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """df with the part of its group's rows at or below the value: ties get the highest rank."""
    low = F.count("*").over(Window.partitionBy(*by, "__block").orderBy(value))
    return blocked(df, by, value).withColumn(name, (F.col("__before") + low) / F.col("__all")).drop("__block", "__before", "__all")


def pct_rank_first(df: DataFrame, by: list[str], value: str, tie: str, name: str = "rank") -> DataFrame:
    """df with row number over count; `tie` stands for the input's order."""
    row = F.row_number().over(Window.partitionBy(*by, "__block").orderBy(value, tie))
    return blocked(df, by, value).withColumn(name, (F.col("__before") + row) / F.col("__all")).drop("__block", "__before", "__all")


def rank_first(df: DataFrame, by: list[str], value: str, tie: str, name: str = "rank") -> DataFrame:
    """df with the rank from 1 in its group, ties in order of `tie`."""
    row = F.row_number().over(Window.partitionBy(*by, "__block").orderBy(value, tie))
    return blocked(df, by, value).withColumn(name, F.col("__before") + row).drop("__block", "__before", "__all")


def average_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """df with the rank from 1 in its group, ties at their mean."""
    w = Window.partitionBy(*by, "__block")
    rank = F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, "__block", value)) - 1) / 2
    return blocked(df, by, value).withColumn(name, F.col("__before") + rank).drop("__block", "__before", "__all")


def offset_before(value: str, spec: WindowSpec) -> Column:
    """The sum of what comes before."""
    return F.coalesce(F.sum(value).over(spec.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def shrinking_mean(df: DataFrame, by: list[str], order: str, value: str, width: int) -> DataFrame:
    """Moving average whose frame is symmetric and shrinks at both ends: half = min(width // 2, i, n - 1 - i).

    Two neighbours for each step of the half-width, all over one window, each counted where the frame reaches it.
    """
    half = F.least(F.lit(width // 2), F.col("i"), F.col("n") - 1 - F.col("i"))
    w = Window.partitionBy(*by)
    rows = df.withColumns({"i": F.row_number().over(w.orderBy(order)) - 1, "n": F.count("*").over(w)})
    parts = [F.col(value)] + [x for k in range(1, width // 2 + 1) for x in (F.when(half >= k, F.lag(value, k).over(w.orderBy(order))), F.when(half >= k, F.lead(value, k).over(w.orderBy(order))))]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return rows.withColumn("smooth", total / (2 * half + 1)).drop("i", "n")


def truncated_mean(value: str, spec: WindowSpec, half: int) -> Column:
    return F.avg(value).over(spec.rowsBetween(-half, half))


def islands(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Runs of consecutive integers."""
    key = F.col(value) - F.row_number().over(Window.partitionBy(*by).orderBy(value))
    return df.select(*by, value).distinct().withColumn("__k", key).groupBy(*by, "__k").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("__k")


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def hash_order(column: str, seed: str = "42") -> Column:
    """A reproducible random order, the same in any engine with MD5."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(column).cast("string")))


def hash_ranked(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """df with rank, from 1, in the group's hash order of a unique column, in 256 blocks by the hash's first byte."""
    named = df.withColumn("__h", hash_order(column)).withColumn("__block", F.substring("__h", 1, 2))
    sizes = named.groupBy(*by, "__block").agg(F.count("*").alias("__n"))
    before = sizes.select(*by, "__block", offset_before("__n", Window.partitionBy(*by).orderBy("__block")).alias("__before"))
    w = Window.partitionBy(*by, "__block").orderBy("__h", column)
    return named.withColumn("__r", F.row_number().over(w)).join(before, [*by, "__block"]).withColumn("rank", F.col("__r") + F.col("__before")).drop("__h", "__block", "__r", "__before")


def blocked(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with __block, __before (the group's rows in lower blocks) and __all (its rows), for ranks by (by, __block).

    Equal values share a block, a few large groups make many tasks each, and ranks are exact wherever the edges lie.
    """
    cut = in_blocks(df, by, value)
    sizes = cut.groupBy(*by, "__block").agg(F.count("*").alias("__rows"))
    w = Window.partitionBy(*by)
    sizes = sizes.select(*by, "__block", offset_before("__rows", w.orderBy("__block")).alias("__before"), F.sum("__rows").over(w).alias("__all"))
    return cut.join(sizes, [*by, "__block"])


def ranked_rows(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with rank, from 1, in its group's order of a unique number, in blocks of values."""
    row = F.row_number().over(Window.partitionBy(*by, "__block").orderBy(value))
    return blocked(df, by, value).withColumn("rank", F.col("__before") + row).drop("__block", "__before", "__all")


def percentiles(df: DataFrame, by: list[str], value: str, parts: dict[str, float]) -> DataFrame:
    """(by, a column for each of parts): exact percentiles with linear interpolation (M20, F18), from how many rows have each value and a lower one."""
    known = df.where(F.col(value).isNotNull()).select(*by, value).withColumn("__key", F.struct(*by))
    at = counted(known.drop("__key"), by, value).withColumn("__key", F.struct(*by))
    rows = at.join(known.groupBy("__key").agg(F.count("*").alias("__all")), "__key")
    outs = []
    for name, p in parts.items():
        place = F.lit(p) * (F.col("__all") - 1)
        low, high = (F.max(F.when((F.col("before") <= f(place)) & (f(place) < F.col("before") + F.col("n")), F.col(value))) for f in (F.floor, F.ceil))
        part = F.max(place - F.floor(place))
        outs.append((low + part * (high - low)).alias(name))
    return rows.groupBy(*by).agg(*outs)


def contained_keys(df: DataFrame, text: str, keys: DataFrame) -> DataFrame:
    """Rows of df with each of keys(key) that their text contains (J25): substrings of the keys' lengths meet keys by equality.

    The different lengths are collected (a text's length bounds them); an empty key is contained in nothing.
    """
    lengths = sorted(r[0] for r in keys.where("length(key) > 0").select(F.length("key")).distinct().collect())

    def parts(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n)))
        return F.when(F.length(text) >= n, every).otherwise(F.expr("CAST(array() AS array<string>)"))

    places = [parts(n) for n in lengths]
    if not places:
        return df.join(keys, F.lit(False))
    return df.withColumn("key", F.explode(F.array_distinct(F.concat(*places)))).join(keys.select("key").distinct(), "key")
