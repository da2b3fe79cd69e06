"""Negatives matched to positives by alleles and distance to a gene's start, none used twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as I  # noqa: E741
from . import windows as W
from .clusters import forget, kept

PLACE, ALLELES = ["chrom", "pos"], ["ref", "alt"]
NEGATIVE = ["neg_chrom", "neg_pos", "neg_gene", "neg_distance"]


def candidate_pairs(positives: DataFrame, variants: DataFrame, genes: DataFrame, reach: int) -> DataFrame:
    """(chrom, pos, ref, alt, gene, distance): variants that are no positive with genes of their chromosome whose start is
    at most reach away (J20), but for a place and gene that a positive has."""
    free = variants.select(*PLACE, *ALLELES).na.drop().distinct().join(positives.select(*PLACE, *ALLELES).distinct(), [*PLACE, *ALLELES], "left_anti")
    around = free.withColumns({"start": F.col("pos") - reach, "end": F.col("pos") + reach + 1})
    starts = genes.where(F.col("tss").isNotNull()).select("chrom", F.col("tss").alias("start"), (F.col("tss") + 1).alias("end"), "gene")
    pairs = I.overlap_join(around, starts, reach + 1).select(*PLACE, *ALLELES, F.col("gene_b").alias("gene"), F.abs(F.col("pos") - F.col("start_b")).alias("distance"))
    return pairs.join(positives.select(*PLACE, "gene").distinct(), [*PLACE, "gene"], "left_anti")


def _asked(waiting: DataFrame, values: DataFrame, tolerance: int) -> DataFrame:
    """(id, ref, alt, v): the value of distance that each waiting positive asks for, of those with free pairs.

    Positives of one (ref, alt, distance) are dealt out, in hash order, to the free pairs within the tolerance, nearest
    values first; positives beyond their number ask for nothing this round.
    """
    key = [*ALLELES, "distance"]
    free = values.where("taken < n").select(*ALLELES, F.col("distance").alias("v"), (F.col("n") - F.col("taken")).alias("left"))
    near = waiting.select(*key).distinct().withColumn("v", F.explode(F.sequence(F.col("distance") - tolerance, F.col("distance") + tolerance)))
    # a group has at most 2 * tolerance + 1 values
    w = Window.partitionBy(*key).orderBy(F.abs(F.col("v") - F.col("distance")), "v").rowsBetween(Window.unboundedPreceding, -1)
    offers = near.join(free, [*ALLELES, "v"]).withColumn("before", F.coalesce(F.sum("left").over(w), F.lit(0)))
    asks = W.hash_ranked(waiting, key, "id").join(offers, key)
    return asks.where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("left"))).select("id", *ALLELES, "v")


def distance_matched(positives: DataFrame, variants: DataFrame, genes: DataFrame, tolerance: int = 10, wide: int = 200, seed: str = "42") -> DataFrame:
    """Each of positives(id, chrom, pos, ref, alt, gene) with a negative: a pair of a variant(chrom, pos, ref, alt) and one
    of genes(gene, chrom, tss), or nulls (J21).

    The variant has the positive's alleles and is no positive; the gene lies on its chromosome, and its start is as far
    from the variant as the positive's gene is from the positive, up to `tolerance`, or up to `wide` where nothing nearer
    is free. No (chrom, pos, gene) is used twice or belongs to a positive. Which pairs of a distance are used follows from
    a hash of seed; the result is maximal: a positive without a negative has no unused pair within `wide`.

    Rounds propose and accept until nobody asks. Pairs have a rank within (ref, alt, distance) once and for all; rounds
    work on how many of a value's pairs are taken, so pairs are read again only by those who get one. On the smallest
    tables 887 positives took 23 rounds: two thirds had a negative after the first, the last twenty took half of them. A positive whose
    gene isn't known, or that has a null place or allele, has no negative. id, and gene in genes, must be unique.
    """
    gene = genes.select("gene", F.col("tss").cast("long").alias("tss"))
    wanted = kept(positives.select("id", "chrom", F.col("pos").cast("long").alias("pos"), *ALLELES, "gene").join(gene, "gene", "left").withColumn("distance", F.abs(F.col("pos") - F.col("tss"))).drop("tss"))
    furthest = wanted.agg(F.max("distance")).first()[0]
    types = {"neg_chrom": wanted.schema["chrom"].dataType, "neg_pos": "long", "neg_gene": wanted.schema["gene"].dataType, "neg_distance": "long"}
    if furthest is None:
        return wanted.withColumns({c: F.lit(None).cast(t) for c, t in types.items()})
    pairs = candidate_pairs(wanted, variants.withColumn("pos", F.col("pos").cast("long")), genes.withColumn("tss", F.col("tss").cast("long")), furthest + wide)
    pairs = pairs.withColumn("who", F.concat_ws(":", F.lit(seed), *PLACE, "gene"))
    pairs = kept(W.hash_ranked(pairs, [*ALLELES, "distance"], "who").drop("who"))
    named = pairs.select(*ALLELES, F.col("distance").alias("v"), F.col("rank").alias("place"), *(F.col(c).alias(f"neg_{c}") for c in ("chrom", "pos", "gene")))
    values = kept(pairs.groupBy(*ALLELES, "distance").agg(F.max("rank").alias("n")).withColumn("taken", F.lit(0).cast("long")))
    waiting = kept(wanted.where(F.col("distance").isNotNull()).na.drop(subset=ALLELES).select("id", *ALLELES, "distance"))
    won = kept(waiting.limit(0).select("id", *(F.lit(None).cast(t).alias(c) for c, t in types.items())))
    for most in (tolerance, wide):
        while True:
            asks = W.hash_ranked(_asked(waiting, values, most), [*ALLELES, "v"], "id")
            asks = kept(asks.join(values.withColumnRenamed("distance", "v"), [*ALLELES, "v"]).select("id", *ALLELES, "v", (F.col("rank") + F.col("taken")).alias("place"), "n"))
            if asks.isEmpty():
                forget(asks)
                break
            got = asks.where("place <= n").join(named, [*ALLELES, "v", "place"])
            # one place and gene may be there with several alleles
            got = W.first_per_key(got, NEGATIVE[:3], ["id"]).join(won.select(*NEGATIVE[:3]), NEGATIVE[:3], "left_anti")
            new = kept(won.unionByName(got.withColumnRenamed("v", "neg_distance").select("id", *NEGATIVE)))
            asked = asks.groupBy(*ALLELES, F.col("v").alias("distance")).agg(F.count("*").alias("asked"))
            after = kept(values.join(asked, [*ALLELES, "distance"], "left").select(*ALLELES, "distance", "n", F.least("n", F.col("taken") + F.coalesce("asked", F.lit(0))).alias("taken")))
            left = kept(waiting.join(new.select("id"), "id", "left_anti"))
            for old in (asks, won, values, waiting):
                forget(old)
            won, values, waiting = new, after, left
    for old in (pairs, values, waiting):
        forget(old)
    return wanted.join(won, "id", "left")


def negative_sets(positives: DataFrame, variants: DataFrame, genes: DataFrame, sets: int, tolerance: int = 10, wide: int = 200) -> DataFrame:
    """distance_matched for each set 1 to `sets`, with a seed of its own; negatives may be used again in another set."""
    out = None
    for k in range(1, sets + 1):
        one = distance_matched(positives, variants, genes, tolerance, wide, str(k)).withColumn("set", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out
