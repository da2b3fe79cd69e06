"""Interval algebra: overlap by shared bins, nearest by ordered windows, merges by running maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import WIDTH, scan

KEY, START, END = "chrom", "start", "end"


def overlap_join(left: DataFrame, right: DataFrame, bin_width: int, closed: bool = False) -> DataFrame:
    """Pairs of left(chrom, start, end, ...) and right that overlap; right's columns get the suffix _b.

    Half-open intervals, or closed ones. Each side is filed under the bins that it touches and met by (chrom, bin), so a
    long chromosome is dealt out over its bins; a pair is emitted in the bin of its larger start only, without a distinct.
    Empty and null intervals overlap nothing.
    """
    more = 0 if closed else 1
    right = right.select(*(F.col(c).alias(f"{c}_b") for c in right.columns))

    def filed(df: DataFrame, s: str, e: str) -> DataFrame:
        last = F.col(e) - more
        return df.where(F.col(s) <= last).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(s) / bin_width), F.floor(last / bin_width))))

    meets = (F.col("start") <= F.col("end_b") - more) & (F.col("start_b") <= F.col("end") - more)
    first = F.floor(F.greatest("start", "start_b") / bin_width)
    pairs = filed(left, START, END).alias("l").join(filed(right, "start_b", "end_b").alias("r"), (F.col("l.chrom") == F.col("r.chrom_b")) & (F.col("l.__bin") == F.col("r.__bin")) & meets & (F.col("l.__bin") == first))
    return pairs.select(*(F.col(f"l.{c}") for c in left.columns), *(F.col(f"r.{c}") for c in right.columns))


def overlap_flag(left: DataFrame, right: DataFrame, key: list[str], bin_width: int, closed: bool = False) -> DataFrame:
    """left with `overlaps` (J12); key identifies its rows."""
    hit = overlap_join(left, right, bin_width, closed).select(*key).distinct().withColumn("overlaps", F.lit(True))
    return left.join(hit, key, "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(False)))


def not_overlapping(left: DataFrame, right: DataFrame, key: list[str], bin_width: int, closed: bool = False) -> DataFrame:
    """Rows of left that no interval of right overlaps."""
    return left.join(overlap_join(left, right, bin_width, closed).select(*key).distinct(), key, "left_anti")


def clipped(pairs: DataFrame) -> DataFrame:
    """The common part of each pair."""
    return pairs.withColumns({"clip_start": F.greatest("start", "start_b"), "clip_end": F.least("end", "end_b")})


def merged(df: DataFrame, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Unions of intervals that overlap or touch (A14): of each start the furthest end, scanned in blocks of positions."""
    own = list(by)
    first = df.groupBy(*own, "start").agg(F.max("end").alias("end"))
    far = scan(first, own, "start", {"__far": ("max", F.col("end"))})
    new = F.when(F.col("__far").isNull() | (F.col("start") > F.col("__far")), F.col("start"))
    named = scan(far.withColumn("__new", new), own, "start", {"__island": ("last", F.col("__new"))}).withColumn("__island", F.coalesce("__new", "__island"))
    return named.groupBy(*own, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def complement(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Gaps between merged intervals from 0 to sizes(chrom, size)."""
    ends = sizes.select("chrom", F.col("size").alias("start"), F.col("size").alias("end"))
    every = scan(merged(df).select("chrom", "start", "end").unionByName(ends), ["chrom"], "start", {"__before": ("last", F.col("end"))}, (F.col("end"),))
    return every.select("chrom", F.coalesce("__before", F.lit(0)).alias("start"), F.col("start").alias("end")).where("start < `end`")


def subtract(left: DataFrame, right: DataFrame, sizes: DataFrame, bin_width: int) -> DataFrame:
    """Parts of left that right doesn't cover."""
    pairs = clipped(overlap_join(left, complement(right, sizes), bin_width))
    return pairs.select("chrom", F.col("clip_start").alias("start"), F.col("clip_end").alias("end"))


def nearest(queries: DataFrame, points: DataFrame) -> DataFrame:
    """queries(chrom, pos, ...) with the nearest of points(chrom, point): point and signed distance point - pos.

    Of two at one distance the left one. One scan of the union in order: the last point before, the first at or after.
    """
    extra = [c for c in queries.columns if c not in ("chrom", "pos")]
    q = queries.select("chrom", "pos", F.lit(None).cast("bigint").alias("point"), F.struct(*extra).alias("__q") if extra else F.struct(F.lit(1).alias("x")).alias("__q"), F.lit(1).alias("kind"))
    p = points.select("chrom", F.col("point").alias("pos"), "point", F.lit(None).cast(q.schema["__q"].dataType).alias("__q"), F.lit(0).alias("kind")).distinct()
    # at one position queries come before points, so that a point there is on their right
    both = scan(q.unionByName(p), ["chrom"], "pos", {"left": ("last", F.col("point")), "right": ("next", F.col("point"))}, (-F.col("kind"),)).where("kind = 1")
    take_left = F.col("right").isNull() | (F.col("pos") - F.col("left") <= F.col("right") - F.col("pos"))
    point = F.when(F.col("left").isNotNull() & take_left, F.col("left")).otherwise(F.col("right"))
    return both.select("chrom", "pos", *(F.col(f"__q.{c}") for c in extra), point.alias("point"), (point - F.col("pos")).alias("distance"))


def band_join(left: DataFrame, right: DataFrame, distance: Column, tolerance: int) -> DataFrame:
    """Pairs with | |pos - point| - d | <= tolerance for left(chrom, pos, d) and right(chrom, point) (J20), by bins of the tolerance."""
    width = max(1, 2 * tolerance)
    sides = F.explode(F.array(F.col("pos") - distance, F.col("pos") + distance))
    a = left.withColumn("__at", sides).withColumn("__bin", F.explode(F.sequence(F.floor((F.col("__at") - tolerance) / width), F.floor((F.col("__at") + tolerance) / width))))
    b = right.withColumn("__bin", F.floor(F.col("point") / width))
    return a.join(b, ["chrom", "__bin"]).where(F.abs(F.abs(F.col("pos") - F.col("point")) - distance) <= tolerance).drop("__bin", "__at").distinct()


def tiles(sizes: DataFrame, width: int, stride: int, margin: int = 0) -> DataFrame:
    """Windows [start, start + width) every `stride` from margin, all within size - margin."""
    last = F.col("size") - margin - width
    ok = sizes.where(last >= margin)
    return ok.select("chrom", F.explode(F.sequence(F.lit(margin).cast("bigint"), last, F.lit(stride).cast("bigint"))).alias("start")).withColumn("end", F.col("start") + width)


def coverage(df: DataFrame) -> DataFrame:
    """Runs (chrom, start, end, depth) of how many intervals cover each position, depth over 0."""
    edges = df.select("chrom", F.col("start").alias("pos"), F.lit(1).alias("d")).union(df.select("chrom", "end", F.lit(-1)))
    edges = edges.groupBy("chrom", "pos").agg(F.sum("d").alias("d")).where("d <> 0")
    steps = scan(edges, ["chrom"], "pos", {"__depth": ("sum", F.col("d")), "__next": ("next", F.col("pos"))})
    return steps.select("chrom", F.col("pos").alias("start"), F.col("__next").alias("end"), (F.col("__depth") + F.col("d")).alias("depth")).where("depth > 0 AND `end` IS NOT NULL")


def most_in_window(df: DataFrame, width: int) -> DataFrame:
    """The largest number of mids in any [mid, mid + width) of a chromosome.

    Mids are counted by position; a block of positions, as wide as a window or wider, also sees the mids of the next one.
    """
    step = max(WIDTH, width)
    at = df.where("mid IS NOT NULL").groupBy("chrom", "mid").agg(F.count("*").alias("c"))
    own = F.floor(F.col("mid") / step)
    filed = at.withColumn("__b", F.explode(F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.struct((own - 1).alias("b"), F.lit(False).alias("own"))))).select("chrom", "mid", "c", "__b.b", "__b.own")
    n = F.sum("c").over(Window.partitionBy("chrom", "b").orderBy("mid").rangeBetween(0, width - 1))
    return filed.select("chrom", "own", n.alias("n")).where("own").groupBy("chrom").agg(F.max("n").alias("most"))
