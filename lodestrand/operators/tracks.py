"""Tracks and series: segments between breakpoints, runs, padding and trimming, scores of an altered track against its reference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .scan import scan


def breakpoints(a: DataFrame, b: DataFrame) -> DataFrame:
    """Segments (chrom, start, end, a, b) between all edges of two sets of intervals, with how many of each cover them.

    One scan of the edges, summed by position first, so a position that many intervals share is one row.
    """
    edges = lambda df, x, y: df.select("chrom", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("e")).select("chrom", "e.pos", (F.col("e.d") * x).alias("a"), (F.col("e.d") * y).alias("b"))
    at = edges(a, 1, 0).union(edges(b, 0, 1)).groupBy("chrom", "pos").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    so_far = scan(at, ["chrom"], "pos", {"__a": ("sum", F.col("a")), "__b": ("sum", F.col("b")), "__next": ("next", F.col("pos"))})
    cut = so_far.select("chrom", F.col("pos").alias("start"), F.col("__next").alias("end"), (F.col("__a") + F.col("a")).alias("a"), (F.col("__b") + F.col("b")).alias("b"))
    return cut.where("`end` IS NOT NULL AND (a > 0 OR b > 0)")


def fold_enrichment(a: Column, b: Column, pseudo: float = 1.0) -> Column:
    """log10 of the ratio of two depths with a pseudocount, not below 0."""
    return F.greatest(F.log10((a + pseudo) / (b + pseudo)), F.lit(0.0))


def runs(df: DataFrame, by: list[str], order: str, state: str) -> DataFrame:
    """Runs (by, first, last, state, n) of rows with one state in order."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = df.withColumn("__new", F.coalesce((~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int"), F.lit(1)))
    marked = marked.withColumn("__new", F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("__new")))
    marked = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.first(state).alias(state), F.count("*").alias("n")).drop("__run")


def padded(df: DataFrame, by: str, value: str, length: DataFrame) -> DataFrame:
    """Series df(by, i, value), i from 0, with their last value up to the one-row `length`(n)."""
    last = df.groupBy(by).agg(F.max("i").alias("last"), F.max_by(value, "i").alias(value))
    more = last.crossJoin(F.broadcast(length)).where("last + 1 < n").select(by, F.explode(F.sequence(F.col("last") + 1, F.col("n") - 1)).alias("i"), value)
    return df.select(by, "i", value).unionByName(more)


def numbered(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """df with i, the place in its group from 0, and n, the group's size."""
    w = Window.partitionBy(*by)
    return df.withColumns({"i": F.row_number().over(w.orderBy(order)) - 1, "n": F.count("*").over(w)})


def to_shortest(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Series cut to the length of the shortest one."""
    shortest = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.min("n").alias("shortest"))
    return numbered(df, by, order).crossJoin(F.broadcast(shortest)).where("i < shortest").drop("n", "shortest")


def variant_scores(df: DataFrame, by: list[str], ref: str, alt: str, position: str) -> DataFrame:
    """Scores of alt against ref over the positions of each group.

    SUM, D1, D2 and JS come from the values, log* from log2(x + 1), sqrt* from the square root. SAX is the difference of
    the largest size (the first position of ties). JS is the mean of both relative entropies of the normalised values plus
    the reference's lower quartile.
    """
    logs = {"": lambda x: F.col(x), "log": lambda x: F.log2(F.col(x) + 1), "sqrt": lambda x: F.sqrt(F.col(x))}
    df = df.select(*by, position, *(f(x).alias(f"{k}_{n}") for k, f in logs.items() for x, n in ((ref, "r"), (alt, "a"))))
    outs = []
    for k in logs:
        d = F.col(f"{k}_a") - F.col(f"{k}_r")
        outs += [F.sum(d).alias(f"{k}SUM"), F.sum(F.abs(d)).alias(f"{k}D1"), F.sqrt(F.sum(d * d)).alias(f"{k}D2")]
    d = F.col("_a") - F.col("_r")
    outs.append(F.max_by(d, F.struct(F.abs(d), -F.col(position))).alias("SAX"))
    totals = [f(F.col(f"{k}_{n}")).alias(f"{k}_{n}_{name}") for k in ("", "log") for n in "ra" for name, f in (("sum", F.sum),)]
    quartiles = [F.percentile(f"{k}_r", 0.25).alias(f"{k}_q") for k in ("", "log")]
    whole = df.groupBy(*by).agg(F.count("*").alias("n"), *totals, *quartiles, *outs)
    shared = df.join(whole.select(*by, "n", *(c.split(" AS ")[0] for c in whole.columns if c.endswith(("_sum", "_q")))), by)
    parts = []
    for k in ("", "log"):
        p, q = ((F.col(f"{k}_{n}") + F.col(f"{k}_q")) / (F.col(f"{k}_{n}_sum") + F.col("n") * F.col(f"{k}_q")) for n in "ra")
        entropy = lambda x, y: F.when((x > 0) & (y > 0), x * F.log(x / y)).when(x == 0, 0.0).otherwise(float("inf"))
        parts.append(((F.sum(entropy(p, q)) + F.sum(entropy(q, p))) / 2).alias(f"{k}JS"))
    js = shared.groupBy(*by).agg(*parts)
    names = ["SUM", "logSUM", "sqrtSUM", "SAX", "D1", "logD1", "sqrtD1", "D2", "logD2", "sqrtD2"]
    return whole.select(*by, *names).join(js, by)


def trim_bounds(df: DataFrame, by: list[str], part: float = 0.3, pad: int = 4) -> DataFrame:
    """(by, trim_start, trim_end, size) of motifs df(by, pos, weight), weight the sum of sizes at a position from 0."""
    top = df.groupBy(*by).agg(F.max("weight").alias("top"), F.count("*").alias("size"))
    ok = F.col("weight") >= F.col("top") * part
    edge = df.join(top, by).groupBy(*by).agg(F.min(F.when(ok, F.col("pos"))).alias("a"), F.max(F.when(ok, F.col("pos"))).alias("b"), F.first("size").alias("size"))
    return edge.select(*by, F.greatest(F.coalesce(F.col("a") - pad, F.lit(0)), F.lit(0)).alias("trim_start"), F.least(F.coalesce(F.col("b") + pad + 1, F.col("size")), F.col("size")).alias("trim_end"), "size")


def seqlet_on_genome(bed_start: Column, start: Column, trim_start: Column, trim_end: Column, size: Column, reverse: Column) -> tuple[Column, Column]:
    """Where a trimmed motif's seqlet lies on the genome."""
    at = bed_start + start
    return at + F.when(reverse, size - trim_end).otherwise(trim_start), at + F.when(reverse, size - trim_start).otherwise(trim_end)


def matched_negatives(positives: DataFrame, candidates: DataFrame, key: list[str], ident: str) -> DataFrame:
    """Each positive with one candidate of its key that isn't a positive, none used twice.

    Both sides are ranked within the key by a hash; equal ranks meet. A key's rows are ranked in 256 blocks of the
    hash and blocks are added up, so a key with a third of all rows isn't one task's.
    """
    from .windows import hash_ranked

    free = candidates.join(positives.select(ident), ident, "left_anti").withColumnRenamed(ident, "negative")
    a, b = hash_ranked(positives, key, ident), hash_ranked(free, key, "negative")
    return a.join(b.select(*key, "rank", "negative"), [*key, "rank"], "left").drop("rank")


#: Windows whose mutants are made at once.
MUTATED = 4096


def _mutant_sums(others: list[str], seq: str, width: int):
    """Each row's count of mutants, sum of their places, least and greatest mutant; a window's mutants are made one place and base at a time.

    Characters are numbers from 1, so that what fills up a short window comes before all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n, places, first, last = np.zeros(rows, np.int64), np.zeros(rows, np.int64), [None] * rows, [None] * rows
            for wide in (False, True):
                held, of, size = [], [], 0
                for r, text in enumerate(batch.column(seq).to_pylist()):
                    if not text or (not text.isascii()) != wide:
                        continue
                    codes = np.frombuffer(text.encode("utf-32-le"), "<u4") + 1 if wide else np.frombuffer(text.encode(), np.uint8) + np.uint8(1)
                    codes = np.pad(codes, (0, -len(codes) % width)).reshape(-1, width)
                    for i in range(0, len(codes), MUTATED):
                        part = codes[i : i + MUTATED]
                        held.append(part)
                        of.append(np.full(len(part), r))
                        size += len(part)
                        if size >= MUTATED:
                            _mutate(np.concatenate(held), np.concatenate(of), wide, n, places, first, last)
                            held, of, size = [], [], 0
                if held:
                    _mutate(np.concatenate(held), np.concatenate(of), wide, n, places, first, last)
            told = lambda v, wide: None if v is None else (np.frombuffer(v + bytes(-len(v) % 4), ">u4") - 1).astype("<u4").tobytes().decode("utf-32-le") if wide else bytes(b - 1 for b in v).decode()
            ends = [[None if v is None else told(*v) for v in end] for end in (first, last)]
            yield pa.record_batch([*(batch.column(c) for c in others), pa.array(n), pa.array(places), *(pa.array(e, pa.string()) for e in ends)], names=[*others, "n", "places", "first", "last"])

    return run


def _mutate(windows: np.ndarray, of: np.ndarray, wide: bool, n: np.ndarray, places: np.ndarray, first: list, last: list) -> None:
    """Adds the mutants of windows, rows of equal width, to the sums of the rows that they are of."""
    kind = ">u4" if wide else np.uint8
    windows = np.ascontiguousarray(windows.astype(kind))
    name = f"S{windows.shape[1] * windows.dtype.itemsize}"
    low, high, any_ = windows.copy(), windows.copy(), np.zeros(len(windows), bool)
    bases, count, total = [ord(b) + 1 for b in "ACGT"], np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    for i in range(windows.shape[1]):
        known = np.isin(windows[:, i], bases)
        for b in bases:
            at = np.flatnonzero(known & (windows[:, i] != b))
            if not len(at):
                continue
            made = windows[at]
            made[:, i] = b
            names = made.view(name).ravel()
            fresh = ~any_[at]
            less = fresh | (names < low[at].view(name).ravel())
            more = fresh | (names > high[at].view(name).ravel())
            low[at[less]], high[at[more]], any_[at] = made[less], made[more], True
            count[at] += 1
            total[at] += i
    np.add.at(n, of, count)
    np.add.at(places, of, total)
    at = np.flatnonzero(any_)
    for r, a, b in zip(of[at].tolist(), low[at].view(name).ravel().tolist(), high[at].view(name).ravel().tolist()):
        if first[r] is None or a < first[r][0]:
            first[r] = (a, wide)
        if last[r] is None or b > last[r][0]:
            last[r] = (b, wide)


def mutant_sums(df: DataFrame, by: list[str], seq: str, width: int = 32) -> DataFrame:
    """(by, n, places, first, last) of all single mutants (Q10) of windows of `width` over the whole of each sequence.

    Rows of mutants would be three times `width` the text, and least and greatest strings are kept by sorting, so a window's
    mutants are made and summed up where it is, a few thousand windows at a time. Groups without a mutant have no row.
    """
    ship(df.sparkSession)
    rows = df.where(F.length(seq) > 0).select(*by, seq)
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    own = rows.mapInArrow(_mutant_sums(by, seq, width), f"{kept}, n long, places long, first string, last string")
    return own.where("n > 0").groupBy(*by).agg(F.sum("n").alias("n"), F.sum("places").alias("places"), F.min("first").alias("first"), F.max("last").alias("last"))


def _best_hits(motifs: list[tuple[str, list[list[float]], float]], seq: str, others: list[str]):
    """Each row's best hit of each motif, of those that reach its part of the perfect score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.full(256, 4, np.uint8)
        code[list(b"ACGT")] = range(4)
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column(seq).to_pylist()):
                if text is None:
                    continue
                letters = code[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]  # a letter each, whatever it is
                for name, weights, part in motifs:
                    width, hits = len(weights), []
                    if len(letters) < width:
                        continue
                    for plus, matrix in ((True, weights), (False, [w[::-1] for w in weights[::-1]])):
                        table = np.column_stack((np.array(matrix, float), np.zeros(width)))
                        score = sum(table[k][letters[k : len(letters) - width + k + 1]] for k in range(width))
                        place = int(score.argmax())
                        hits.append((float(score[place]), plus, -place))
                    score, plus, place = max(hits)
                    if score >= part * sum(map(max, weights)):
                        rows.append(row)
                        out.append((name, score, -place, "+" if plus else "-"))
            own = batch.select(others).take(pa.array(rows, pa.int64()))
            hit = [pa.array([x[c] for x in out], t) for c, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.string()))]
            yield pa.record_batch([*own.columns, *hit], names=[*others, "motif", "score", "place", "strand"])

    return run


def pwm_scan(df: DataFrame, by: list[str], seq: str, motifs: dict[str, list[list[float]]], part: float) -> DataFrame:
    """(by, motif, score, place, strand): the best hit of each motif (rows over ACGT) in each whole sequence, on either
    strand, from `part` of its perfect score (Q14).

    Of equal scores the + strand's first one. Other letters add nothing; a null sequence, or one shorter than a motif, has no hit.
    """
    ship(df.sparkSession)
    asked = [(name, weights, part) for name, weights in motifs.items()]
    schema = T.StructType([*(df.schema[c] for c in by), T.StructField("motif", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("place", T.LongType()), T.StructField("strand", T.StringType())])
    return df.select(*by, seq).mapInArrow(_best_hits(asked, seq, by), schema)

