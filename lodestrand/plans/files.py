"""Queries of binary sources and sinks: what Spark derives from the tables is written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import intervals as I  # noqa: E741
from ..operators import shuffles, smoothing
from ..operators.windows import ranked_rows
from ..session import shared_folder
from ..sources import bigwig, hdf5, npz, resume, text, tfrecord
from .inventory import PEAKS, Tables, both
from .more import S, dna


def folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def chrom(df):
    return df.withColumn("chrom", F.concat(F.lit("chr"), F.col("chrom")))


def s12(t: Tables):
    """Coverage of the peaks as BigWig, read back for the chromosomes and range that a filter names."""
    path = folder(t, "coverage") + ".bw"
    bigwig.write_bigwig(chrom(I.coverage(t.peaks)).withColumnRenamed("depth", "value"), path)
    runs = bigwig.read_track(t.spark, path).where(F.col("chrom").isin("chr3", "chr11", "chr24") & (F.col("start") < 900) & (F.col("end") > 100))
    return runs.groupBy("chrom", F.col("value").cast("long").alias("depth")).agg(F.sum(F.least("end", F.lit(900)) - F.greatest("start", F.lit(100))).alias("bp"))


both("s12_bigwig_coverage", s12, f"WITH {PEAKS} SELECT 'chr' || chrom AS chrom, depth, count(*) AS bp FROM (SELECT chrom, x, count(*)::BIGINT AS depth FROM (SELECT chrom, unnest(range(start, \"end\")) AS x FROM peaks WHERE chrom IN (3, 11, 24)) GROUP BY 1, 2) WHERE x >= 100 AND x < 900 GROUP BY 1, 2")


def s13(t: Tables):
    """Peaks as a BED file, read back as a track, its values over windows of 250 positions."""
    path = folder(t, "peaks") + ".bed"
    chrom(t.peaks).select(F.concat_ws("\t", "chrom", "start", "end").alias("value")).write.text(path)
    sizes = chrom(t.peaks).groupBy("chrom").agg(F.max("end").alias("size"))
    values = bigwig.read_windows(bigwig.read_track(t.spark, path), I.tiles(sizes, 250, 250))
    return values.select("chrom", "start", F.size("values").cast("long").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, v: a + v).cast("long").alias("painted"), F.array_position("values", F.lit(1.0).cast("float")).alias("first"))


both(
    "s13_painted_windows", s13, f"WITH {PEAKS}, x AS (SELECT DISTINCT chrom, unnest(range(start, \"end\")) AS x FROM peaks), z AS (SELECT chrom, max(\"end\") AS size FROM peaks GROUP BY 1), w AS (SELECT chrom, unnest(range(0, size - 249, 250)) AS start FROM z) "
    "SELECT 'chr' || w.chrom AS chrom, start, 250::BIGINT AS n, count(x) AS painted, coalesce(min(x) - start + 1, 0) AS first FROM w LEFT JOIN x ON x.chrom = w.chrom AND x // 250 = start // 250 GROUP BY w.chrom, start",
)


def s18(t: Tables):
    """Documents as compressed Examples of 32 to a file, read back; digests of what was read."""
    path = folder(t, "tfrecords")
    rows = t.documents.select("doc_id", F.encode("text", "utf-8").alias("sequence"), F.split("source", "").alias("letters"), F.array(F.col("n_chars") / 2, F.lit(0.25)).alias("sizes"))
    tfrecord.write_tfrecords(rows, path)
    read = tfrecord.read_tfrecords(t.spark, path, "doc_id long, sequence binary, letters array<string>, sizes array<double>")
    return read.select("doc_id", F.md5("sequence").alias("md5"), F.array_join("letters", "").alias("source"), F.element_at("sizes", 1).alias("half"), F.size("sizes").alias("n"))


both("s18_k5_tfrecords", s18, "SELECT doc_id, md5(text) AS md5, source, n_chars / 2 AS half, 2 AS n FROM documents")


def k10(t: Tables):
    """Customers in parts by nation: written, then written again after some changed; what each run wrote."""
    path = folder(t, "parts")
    rows = t.customer.select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("double").alias("balance"))
    first = resume.write_parts(rows, F.col("c_nationkey"), path, order=("c_custkey",))
    changed = rows.withColumn("balance", F.when(F.col("c_nationkey") < 3, F.lit(0.0)).otherwise(F.col("balance")))
    second = resume.write_parts(changed, F.col("c_nationkey"), path, order=("c_custkey",))
    ran = t.spark.createDataFrame([(p, n, "first") for p, n, _ in first] + [(p, n, "second") for p, n, _ in second], "part long, told long, run string")
    read = tfrecord.read_tfrecords(t.spark, path, "c_custkey long, c_nationkey long, balance double").groupBy(F.col("c_nationkey").alias("part")).agg(F.count("*").alias("n"), F.round(F.sum("balance"), 0).alias("balance"))
    return ran.join(read, "part")


both(
    "k10_resumed_parts", k10, "WITH p AS (SELECT c_nationkey AS part, count(*) AS n, round(sum(CASE WHEN c_nationkey < 3 THEN 0 ELSE c_acctbal::FLOAT END), 0)::DOUBLE AS balance FROM customer GROUP BY 1) "
    "SELECT part::BIGINT AS part, n AS told, 'first' AS run, n, balance FROM p UNION ALL SELECT part::BIGINT, n, 'second', n, balance FROM p WHERE part < 3",
)


def s17(t: Tables):
    """Embeddings as arrays of 8 x 8 for each label, written as archives and read back by ranges of rows."""
    path = folder(t, "arrays")
    numbered = t.embeddings.where("size(embedding) = 64").select(F.concat(F.lit("label"), "label").alias("member"), "vec_id", F.col("embedding").cast("array<double>").alias("values"))
    first = numbered.groupBy("member").agg(F.count("*").alias("n")).withColumn("shape", F.array(F.lit(8), F.lit(8)))
    rows = ranked_rows(numbered, ["member"], "vec_id").withColumn("row", F.col("rank") - 1).join(first, "member")
    npz.write_npz(rows.select("member", "row", "shape", "values"), path)
    read = npz.read_npz(t.spark, path)
    return read.select("member", "row", F.element_at("shape", 1).alias("height"), F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.round(F.element_at("values", 64), 4).alias("last"))


both(
    "s17_k6_arrays", s17, "SELECT 'label' || label AS member, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row, 8::BIGINT AS height, round(list_sum([x::DOUBLE FOR x IN embedding]), 4) AS total, round(embedding[64]::DOUBLE, 4) AS last "
    "FROM embeddings WHERE len(embedding) = 64",
)


def s21(t: Tables):
    """Motifs of suppliers, from counts of their line items by line number, as a MEME library, read back."""
    path = folder(t, "motifs")
    flags = [F.count_if(F.col("l_returnflag") == x) for x in "ANR"]
    rows = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.array(*(c.cast("double") for c in (*flags, F.count("*")))).alias("r"))
    motifs = rows.groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "r"))), lambda x: x["r"]).alias("matrix"))
    text.meme_records(motifs.select(F.concat(F.lit("supplier-"), "l_suppkey").alias("name"), "matrix")).write.text(path)
    read = text.meme(t.spark, path)
    return read.select("name", "width", F.posexplode("matrix").alias("pos", "r")).select("name", "width", "pos", *(F.get("r", F.lit(i)).alias(c) for i, c in enumerate("acgt")))


both(
    "s21_k7_motif_library", s21, "WITH r AS (SELECT l_suppkey, l_linenumber, count(*) FILTER (l_returnflag = 'A')::DOUBLE AS a, count(*) FILTER (l_returnflag = 'N')::DOUBLE AS c, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS g, count(*)::DOUBLE AS t FROM lineitem GROUP BY 1, 2) "
    "SELECT 'supplier-' || l_suppkey AS name, count(*) OVER (PARTITION BY l_suppkey) AS width, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber) - 1 AS pos, a, c, g, t FROM r",
)
both(
    "r9_window_shuffles", lambda t: shuffles.window_shuffles(dna(t).select("doc_id", "s"), "doc_id", "s", 200).select("doc_id", F.explode(F.expr("transform(sequence(1, greatest(length(shuffled) - 1, 1)), i -> substring(shuffled, i, 2))")).alias("pair")).where("length(pair) = 2").groupBy("doc_id", "pair").agg(F.count("*").alias("n")),
    f"SELECT doc_id, pair, count(*) AS n FROM (SELECT doc_id, unnest([substr(s, k, 2) FOR k IN range(1, greatest(length(s), 1)) IF k % 200 <> 0]) AS pair FROM {S}) GROUP BY 1, 2",
)


def s14(t: Tables):
    """Scores of line items in nested groups, by status and flag, read back; the mean of each group."""
    path = folder(t, "scores")
    member = F.concat(F.lit("scores/"), "l_linestatus", F.lit("/"), "l_returnflag")
    hdf5.write_hdf5(t.lineitem.select(member.alias("member"), F.col("l_extendedprice").cast("double").alias("score")), path)
    return hdf5.read_hdf5(t.spark, path, "member string, score double").groupBy("member").agg(F.count("*").alias("n"), F.round(F.avg("score"), 2).alias("mean"))


both("s14_nested_scores", s14, "SELECT 'scores/' || l_linestatus || '/' || l_returnflag AS member, count(*) AS n, round(avg(l_extendedprice::DOUBLE), 2) AS mean FROM lineitem GROUP BY 1")


def s15(t: Tables):
    """Hits of patterns as datasets side by side, read back as rows by position; what each pattern and strand has."""
    path = folder(t, "hits")
    start = F.col("l_linenumber").cast("long") * 8
    hits = t.lineitem.select(
        F.concat(F.lit("patterns/"), "l_returnflag", F.lit("/seqlets")).alias("member"), F.col("l_orderkey").cast("long").alias("example"), start.alias("start"),
        (start + F.col("l_quantity").cast("long")).alias("end"), (F.col("l_linestatus") == "F").alias("backward"), F.concat(F.lit("day-"), F.dayofmonth("l_shipdate")).alias("name"),
    )
    hdf5.write_hdf5(hits, path, order=("example", "start"))
    read = hdf5.read_hdf5(t.spark, path, "member string, example long, start long, end long, backward int, name string")
    return read.groupBy(F.split("member", "/")[1].alias("pattern"), "backward").agg(F.count("*").alias("n"), F.sum("example").alias("examples"), F.sum(F.col("end") - F.col("start")).alias("bp"), F.sum(F.col("start") * F.length("name")).alias("weight"), F.countDistinct("name").alias("names"))


both(
    "s15_pattern_hits", s15, "SELECT l_returnflag AS pattern, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS backward, count(*) AS n, sum(l_orderkey)::BIGINT AS examples, sum(l_quantity::BIGINT)::BIGINT AS bp, "
    "sum(l_linenumber * 8 * length('day-' || day(l_shipdate)))::BIGINT AS weight, count(DISTINCT day(l_shipdate)) AS names FROM lineitem GROUP BY 1, 2",
)


def s16(t: Tables):
    """Arrays of scores with a gene's name each, in order of genes; those of three genes, whose blocks alone are decoded."""
    path = folder(t, "genes")
    scores = F.array(*(F.col(c).cast("double") for c in ("l_extendedprice", "l_discount", "l_tax")))
    hdf5.write_hdf5(t.lineitem.select(F.lit("variants").alias("member"), F.concat(F.lit("G"), "l_suppkey").alias("genes"), scores.alias("scores")), path, order=("genes",))
    own = hdf5.read_hdf5(t.spark, path, "genes string, scores array<double>").where(F.col("genes").isin("G1", "G7", "G10"))
    return own.groupBy("genes").agg(F.count("*").alias("n"), *(F.round(F.sum(F.col("scores")[i]), 2).alias(c) for i, c in enumerate(("price", "discount", "tax"))))


both("s16_rows_of_genes", s16, "SELECT 'G' || l_suppkey AS genes, count(*) AS n, round(sum(l_extendedprice::DOUBLE), 2) AS price, round(sum(l_discount::DOUBLE), 2) AS discount, round(sum(l_tax::DOUBLE), 2) AS tax FROM lineitem WHERE l_suppkey IN (1, 7, 10) GROUP BY 1")


def r16(t: Tables):
    """Line items counted by supplier and quantity, a matrix for each flag, smoothed."""
    cells = t.lineitem.groupBy(F.col("l_returnflag").alias("matrix"), (F.col("l_suppkey").cast("long") - 1).alias("i"), (F.col("l_quantity").cast("long") - 1).alias("j")).agg(F.count("*").cast("double").alias("v"))
    return smoothing.gaussian(cells, ["matrix"], sigma=1.0, truncate=2.0).select("matrix", "i", "j", F.round("v", 6).alias("v"))


both(
    "r16_smoothed_matrix", r16, "WITH c AS (SELECT l_returnflag AS matrix, l_suppkey::BIGINT - 1 AS i, l_quantity::BIGINT - 1 AS j, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1, 2, 3), n AS (SELECT matrix, max(i) + 1 AS ni, max(j) + 1 AS nj FROM c GROUP BY 1), "
    "k AS (SELECT k, exp(-k * k / 2.0) / sum(exp(-k * k / 2.0)) OVER () AS w FROM range(-2, 3) r(k)), a AS (SELECT matrix, i, nj, unnest([j, -1 - j, 2 * nj - 1 - j]) AS p, v FROM c JOIN n USING (matrix)), "
    "b AS (SELECT matrix, i, p + k AS j, sum(v * w) AS v FROM a, k WHERE p + k >= 0 AND p + k < nj GROUP BY 1, 2, 3), d AS (SELECT matrix, j, ni, unnest([i, -1 - i, 2 * ni - 1 - i]) AS p, v FROM b JOIN n USING (matrix)) "
    "SELECT matrix, p + k AS i, j, round(sum(v * w), 6) AS v FROM d, k WHERE p + k >= 0 AND p + k < ni GROUP BY 1, 2, 3",
)


def k2(t: Tables):
    """Peaks as BED files by fold and all together, read back: rows and bases of each file."""
    path = folder(t, "folds")
    peaks = chrom(t.peaks).withColumn("fold", F.when(F.col("chrom") == "chr3", "test").when(F.col("chrom") == "chr4", "valid").otherwise("train"))
    text.write_bed(peaks.select("chrom", "start", "end", "fold"), path, "fold")
    lines = t.spark.read.text(path).select("fold", F.split("value", "\t").alias("f"))
    return lines.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.col("f")[2].cast("long") - F.col("f")[1].cast("long")).alias("bp"))


both("k2_bed_by_fold", k2, f"WITH {PEAKS}, f AS (SELECT CASE WHEN chrom = 3 THEN 'test' WHEN chrom = 4 THEN 'valid' ELSE 'train' END AS fold, \"end\" - start AS size FROM peaks) SELECT fold, count(*) AS n, sum(size)::BIGINT AS bp FROM f GROUP BY 1 UNION ALL SELECT 'all', count(*), sum(size)::BIGINT FROM f")


def k9(t: Tables):
    """Mean prices of suppliers' returned line items against their mean over all, checked in four modes, as CSV, read back."""
    path = folder(t, "verdicts")
    price = F.col("l_extendedprice").cast("double")
    mode = F.element_at(F.array(*map(F.lit, ("approx", "ge", "gt", "le"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    rows = t.lineitem.groupBy("l_suppkey").agg(F.round(F.avg(price), 2).alias("reported"), F.round(F.avg(F.when(F.col("l_returnflag") == "R", price)), 2).alias("reproduced"))
    checks = rows.select(F.col("l_suppkey").cast("long").alias("panel"), "reported", "reproduced", mode.alias("mode"), F.lit(0.02).alias("rtol"), F.lit(10.0).alias("atol"))
    checks = checks.withColumn("delta", F.round(F.col("reproduced") - F.col("reported"), 2)).withColumn("verdict", C.verdict(*(F.col(c) for c in ("reported", "reproduced", "mode", "rtol", "atol"))))
    text.write_delimited(checks, path, ",")
    return text.delimited(t.spark, path, checks.schema, ",")


both(
    "k9_verdicts", k9, "WITH r AS (SELECT l_suppkey::BIGINT AS panel, round(avg(l_extendedprice::DOUBLE), 2) AS reported, round(avg(l_extendedprice::DOUBLE) FILTER (l_returnflag = 'R'), 2) AS reproduced, ['approx', 'ge', 'gt', 'le'][l_suppkey % 4 + 1] AS mode FROM lineitem GROUP BY l_suppkey) "
    "SELECT panel, reported, reproduced, mode, 0.02::DOUBLE AS rtol, 10.0::DOUBLE AS atol, round(reproduced - reported, 2) AS delta, CASE WHEN reproduced IS NULL OR reported IS NULL THEN 'MISSING' WHEN CASE mode WHEN 'ge' THEN reproduced >= reported - 10 WHEN 'gt' THEN reproduced > reported WHEN 'le' THEN reproduced <= reported + 10 ELSE abs(reproduced - reported) <= 10.0::DOUBLE + 0.02::DOUBLE * abs(reported) END THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r",
)


def s28(t: Tables):
    """Parts of two tables as lines, the one with a comment and a header, the other with neither; the named or third field of each."""
    path = folder(t, "targets")
    orders = t.orders.select(F.concat_ws("\t", "o_orderpriority", F.concat(F.lit("N"), F.col("o_custkey") % 25), "o_orderkey").alias("value"))
    parts = t.part.select(F.concat_ws("\t", "p_partkey", "p_size", "p_brand").alias("value"))
    head = t.region.groupBy().agg(F.array(F.concat(F.lit("! regions: "), F.count("*")), F.lit("Priority\tTarget\tKey")).alias("v")).select(F.explode("v").alias("value"))
    orders.union(head).coalesce(1).write.text(f"{path}/named")
    parts.write.text(f"{path}/placed")
    read = text.named_or_placed(t.spark, [f"{path}/named", f"{path}/placed"], "Target", 2)
    return read.groupBy(F.col("value").alias("target")).agg(F.count("*").alias("n"))


both("s28_named_or_placed", s28, "SELECT 'N' || (o_custkey % 25) AS target, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT p_brand, count(*) FROM part GROUP BY 1")
both(
    "c17_half", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", C.to_half(F.col("l_extendedprice").cast("double") * (F.col("l_discount").cast("double") - 0.03)).alias("half"), C.to_half(F.lit(1.0) / (F.col("l_orderkey") + 1)).alias("small")),
    "WITH x AS (SELECT l_orderkey, l_linenumber, least(greatest(l_extendedprice::DOUBLE * (l_discount::DOUBLE - 0.03::DOUBLE), -65504), 65504) AS a, 1.0::DOUBLE / (l_orderkey + 1) AS b FROM lineitem), y AS (SELECT *, pow(2, greatest(floor(log2(nullif(abs(a), 0))) - 10, -24)) AS sa, pow(2, greatest(floor(log2(b)) - 10, -24)) AS sb FROM x) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN a = 0 THEN a ELSE round_even(a / sa, 0) * sa END AS half, round_even(b / sb, 0) * sb AS small FROM y",
)
