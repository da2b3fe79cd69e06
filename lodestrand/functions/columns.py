"""Scalar, DNA and track functions as Column expressions (single_mutants over rows); none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The roman numerals of the sixteen chromosomes.
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI")
HALF_MAX = 65504.0


def canonical_chromosome(c: Column) -> Column:
    """1, I, chromosome1 or chrI as chrI; other names pass through."""
    bare = F.regexp_replace(c, "^(chromosome|chr)", "")
    number = F.when(bare.rlike("^([1-9]|1[0-6])$"), F.get(F.array(*map(F.lit, ROMAN)), bare.try_cast("int") - 1))
    roman = F.when(bare.isin(*ROMAN), bare)
    return F.coalesce(F.concat(F.lit("chr"), F.coalesce(number, roman)), c)


def chromosome_order(c: Column) -> Column:
    """1 to 16 for roman or arabic names, null else (O2)."""
    return F.nullif(F.array_position(F.array(*map(F.lit, ROMAN)), F.regexp_replace(canonical_chromosome(c), "^chr", "")), F.lit(0))


def accession(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[.-]", "_"), r"[()]", "")


def exact_sum(c: Column) -> Column:
    """The sum of doubles, the same in whatever order rows come: in decimals with twelve places, for a threshold or an order by it.

    A group with a value that is no number, or of 1e16 or more, has the plain sum.
    """
    fits = F.abs(c) < 1e16
    return F.when(F.count_if(~fits) > 0, F.sum(c)).otherwise(F.sum(F.when(fits, c.cast("decimal(28,12)"))).cast("double"))


def exact_avg(c: Column) -> Column:
    return exact_sum(c) / F.count(c)


def finite(c: Column) -> Column:
    """Null for NaN and infinity."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def right_closed_bin(c: Column, edges: list[float]) -> Column:
    """(edge, next edge] labels; nothing at or below the first edge or above the last."""
    out = None
    for a, b in zip(edges, edges[1:]):
        hit, label = (c > a) & (c <= b), F.lit(f"{a:g}-{b:g}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def signed_distance(tss: Column, pos: Column, strand: Column) -> Column:
    return F.when(strand == "+", tss - pos).otherwise(pos - tss)


def tss_of(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "+", start).otherwise(end)


def tss_window(tss: Column, strand: Column, up: int, down: int) -> tuple[Column, Column]:
    """Start and end of a strand-aware window, clipped at 0."""
    plus = strand == "+"
    return F.greatest(F.when(plus, tss - up).otherwise(tss - down), F.lit(0)), F.when(plus, tss + down).otherwise(tss + up)


def window_start(lo: Column, hi: Column, centre: Column, half: int) -> Column:
    """The middle of the feasible [lo, hi], or around the centre if there is none."""
    return F.when(lo <= hi, F.floor((lo + hi) / 2)).otherwise(centre - half)


def log_ratio(alt: Column, ref: Column, epsilon: float = 1e-12) -> Column:
    return F.log((alt + epsilon) / (ref + epsilon))


def log_sed(alt: Column, ref: Column) -> Column:
    """log2(sum of alt + 1) - log2(sum of ref + 1) over arrays."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return F.log2(total(alt) + 1) - F.log2(total(ref) + 1)


def half_clip(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(HALF_MAX)), F.lit(-HALF_MAX)))  # least passes over nulls


def to_half(c: Column) -> Column:
    """The number of 16 bits that is nearest to c clipped, ties to even (C17); null and NaN stay."""
    x = half_clip(c.cast("double"))
    x = F.when(F.isnan(c), c.cast("double")).otherwise(x)
    # eleven bits of a normal number, steps of 2**-24 below 2**-14
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))) - 10, F.lit(-24)))
    return F.when((x == 0) | F.isnan(x), x).otherwise(F.rint(x / step) * step)


def verdict(reported: Column, found: Column, mode: Column, rtol: Column, atol: Column) -> Column:
    """PASS, FAIL or MISSING of a check: `ge`, `gt` and `le` compare, any other mode takes what is near (K9)."""
    slack = atol + rtol * F.abs(reported)
    holds = F.when(mode == "ge", found >= reported - atol).when(mode == "gt", found > reported).when(mode == "le", found <= reported + atol).otherwise(F.abs(found - reported) <= slack)
    missing = reported.isNull() | found.isNull() | F.isnan(reported) | F.isnan(found)
    return F.when(missing, "MISSING").when(holds, "PASS").otherwise("FAIL")


def number_in(c: Column) -> Column:
    """The number at a name's end, null if there is none."""
    return F.regexp_extract(c, r"(\d+)$", 1).try_cast("int")


def first_match(c: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first text that c contains (C8, C10); the order counts."""
    out = F
    for text, label in rules:
        out = out.when(F.contains(c, F.lit(text)), label)
    return out.otherwise(otherwise)


def level_of(c: Column, levels: dict[str, int]) -> Column:
    """The level of the first text that c contains, 0 if none (F16)."""
    out = F
    for text, level in levels.items():
        out = out.when(F.contains(c, F.lit(text)), level)
    return out.otherwise(0)


def timepoint(name: Column) -> Column:
    """The number of _T<number>_ in a name."""
    return F.regexp_extract(name, r"_T(\d+)_", 1).try_cast("int")


def insertion_place(name: Column) -> Column:
    """100 + 10 for each step of ctx<number> in a name (C11)."""
    return 100 + 10 * F.regexp_extract(name, r"ctx(\d+)", 1).try_cast("int")


def mapped(c: Column, labels: dict[str, str]) -> Column:
    """A fixed renaming; other values pass through."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[c], c)


def shifted_log(x: Column, least: Column) -> Column:
    """log after a shift that makes all values positive."""
    return F.log(x + F.when(least <= 0, 1 - least).otherwise(0.0) + 1e-8)


def is_local(a: Column, b: Column, same: Column, reach: int) -> Column:
    """Within reach on one chromosome."""
    return (F.abs(a - b) <= reach) & same


def promoter(start: Column, end: Column, strand: Column, size: Column, width: int) -> tuple[Column, Column]:
    """The window of `width` before a gene's start, within 0 and the chromosome's size."""
    plus = strand == "+"
    return F.when(plus, F.greatest(start - width, F.lit(0))).otherwise(end), F.when(plus, start).otherwise(F.least(end + width, size))


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole, 0 where whole is 0."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


# DNA


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGTacgt", "TGCAtgca"))


def one_hot(c: Column) -> Column:
    """An array (A, C, G, T) for each base; unknown bases are zeros (Q2)."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.array(*((F.upper(x) == b).cast("int") for b in "ACGT")))


def from_one_hot(c: Column) -> Column:
    base = F.array(*map(F.lit, "ACGT"))
    return F.array_join(F.transform(c, lambda v: F.get(base, (F.array_position(v, F.array_max(v)) - 1).cast("int"))), "")


def masked(c: Column) -> Column:
    """Lower-case letters and N (Q4)."""
    return F.length(F.regexp_replace(c, "[^a-zN]", ""))


def transfer_mask(seq: Column, mask: Column) -> Column:
    """Bases of seq, lower case where mask is (Q5)."""
    chars = lambda s: F.filter(F.split(s, ""), lambda x: x != "")
    return F.array_join(F.zip_with(chars(seq), chars(mask), lambda a, b: F.when(b.rlike("[a-z]"), F.lower(a)).otherwise(a)), "")


def substitute(seq: Column, offset: Column, alt: Column, ref_length: Column) -> Column:
    """seq with ref_length bases from offset (0-based) replaced (Q7)."""
    return F.overlay(seq, alt, offset + 1, ref_length)


def single_mutants(df: DataFrame, seq: str) -> DataFrame:
    """df with pos, ref, alt and mutant, three rows for each of ACGT in the column seq (Q10).

    Mutants of one sequence take its length squared, so they are made row by row and never held together.
    """
    at = df.where(F.length(seq) > 0).withColumn("pos", F.explode(F.sequence(F.lit(0), F.length(seq) - 1))).withColumn("ref", F.substring(F.col(seq), F.col("pos") + 1, F.lit(1)))
    each = at.where(F.col("ref").isin(*"ACGT")).withColumn("alt", F.explode(F.array(*map(F.lit, "ACGT")))).where("alt <> ref")
    return each.withColumn("mutant", F.overlay(F.col(seq), F.col("alt"), F.col("pos") + 1, F.lit(1)))


def fetch(seq: Column, start: Column, end: Column) -> Column:
    """Bases [start, end), N beyond either end."""
    left = F.greatest(-start, F.lit(0))
    inner = F.substring(seq, F.greatest(start, F.lit(0)) + 1, F.greatest(F.least(end, F.length(seq)) - F.greatest(start, F.lit(0)), F.lit(0)))
    return F.rpad(F.concat(F.repeat(F.lit("N"), left), inner), end - start, F.lit("N"))


def frequencies(cwm: Column, pseudo: float = 1e-4) -> Column:
    """Rows of absolute weights plus a pseudocount, scaled to one (Q11)."""
    row = lambda r: F.transform(r, lambda x: F.abs(x) + pseudo)
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda a, b: a + b)
    return F.transform(cwm, lambda r: F.transform(row(r), lambda x: x / total(row(r))))


def reverse_complement_matrix(m: Column) -> Column:
    return F.reverse(F.transform(m, lambda r: F.reverse(r)))


def information(row: Column, pseudo: float = 1e-9) -> Column:
    """2 + sum of p log2 p (Q13)."""
    return F.lit(2.0) + F.aggregate(row, F.lit(0.0), lambda a, p: a + p * F.log2(p + pseudo))


def scaled(row: Column) -> Column:
    return F.transform(row, lambda x: x / F.aggregate(row, F.lit(0.0), lambda a, y: a + y))


def log_mean_ratio(row: Column) -> Column:
    """x ln(x / mean) for each x of a row (Q15)."""
    return F.transform(row, lambda x: x * F.log(x / (F.aggregate(row, F.lit(0.0), lambda a, y: a + y) / F.size(row))))


def centred(seq: Column, width: int) -> Column:
    """The middle `width` bases, or the sequence with N on both sides (Q9)."""
    n = F.length(seq)
    left = F.floor((width - n) / 2).cast("int")
    cut = F.substring(seq, F.floor((n - width) / 2).cast("int") + 1, F.lit(width))
    return F.when(n >= width, cut).otherwise(F.concat(F.repeat(F.lit("N"), left), seq, F.repeat(F.lit("N"), width - n - left)))


# tracks

#: What a bin's values become.
POOLS = {
    "sum": lambda x: F.sum(x), "sum_sqrt": lambda x: F.sqrt(1 + F.sum(x)) - 1, "sum_exp75": lambda x: F.pow(1 + F.sum(x), 0.75) - 1, "mean": lambda x: F.avg(x),
    "mean_sqrt": lambda x: F.sqrt(1 + F.avg(x)) - 1, "median": lambda x: F.median(x), "max": lambda x: F.max(x), "peak": lambda x: F.greatest(F.least(F.sqrt(4 * F.max(x)), F.lit(1.0)), F.lit(0.0)),
}


def soft_clip(x: Column, c: float) -> Column:
    return F.when(x > c, c - 1 + F.sqrt(x - c + 1)).otherwise(x)


def soft_clip_plain(x: Column, c: float) -> Column:
    """The second form, without the step of 1 (R2)."""
    return F.when(x > c, c + F.sqrt(x - c)).otherwise(x)


def unscaled(y: Column, scale: float, clip: float, power: float) -> Column:
    """What a scaled, softly clipped power of a track was."""
    x = y / scale
    return F.pow(F.when(x > clip, F.pow(x - clip, 2) + clip).otherwise(x), 1.0 / power)


def ism_scores(distal: Column, proximal: Column) -> dict[str, Column]:
    """Scores of two sums or means: log, log of their ratio, log odds."""
    ratio = distal / proximal
    return {"plain": F.log(distal + 1e-6), "ratio": F.log(ratio + 1e-6), "log_odds": F.log(ratio / (1 - ratio) + 1e-6)}


def hard_clip(x: Column, c: float) -> Column:
    return F.greatest(F.least(x, F.lit(c)), F.lit(-c))


def snap_window(start: Column, end: Column, bin_width: int = 16) -> tuple[Column, Column]:
    """The window grown to whole bins; floors, so negative positions work too."""
    return F.floor(start / bin_width) * bin_width, F.ceil(end / bin_width) * bin_width
