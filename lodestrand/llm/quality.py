"""Quality rules: counts of each text, and how often its lines occur across documents, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: A line is taken for boilerplate if so many documents of a host have it, and so large a part of them.
LINE_DOCS, LINE_PART = 20, 0.05
#: A document is depleted if fewer words are left, or a smaller part of its words.
LEFT_WORDS, LEFT_PART = 20, 0.3
MIN_WORDS, REPEAT_PART = 50, 50
#: Stands for a null doc_id in joins.
NULL_ID = -(1 << 63)


def normalised(line):
    """White space runs as one space, none at the ends, lower case."""
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (NULL_ID for null), twin (a hash of the text), host and text of each row, for joins."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("twin"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), text.alias("text"))


KEY = ["doc_id", "twin", "host"]


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, twin, host (see `keyed`) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    t = keyed(docs).select(*KEY, "text", F.filter(F.split("text", SPACE), lambda w: w != "").alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    gram = F.expr("CASE WHEN size(w) >= 3 THEN sort_array(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS i))) ELSE CAST(array() AS array<struct<h: bigint, i: int>>) END")
    t = t.select(
        *KEY, F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), gram.alias("g"),
    )
    again = F.expr("sort_array(transform(filter(g, (x, j) -> (j > 0 AND g[greatest(j - 1, 0)].h = x.h) OR (j < size(g) - 1 AND g[least(j + 1, size(g) - 1)].h = x.h)), x -> x.i))")
    t = t.select(*KEY, "n_words", "word_chars", "n_symbols", "n_dup_lines", again.alias("p"))
    words = F.expr("aggregate(transform(p, (x, j) -> CASE WHEN j = size(p) - 1 THEN 3 ELSE least(3, p[least(j + 1, size(p) - 1)] - x) END), 0, (a, b) -> a + b)")
    return t.select(*KEY, "n_words", "word_chars", "n_symbols", "n_dup_lines", words.cast("long").alias("n_repeat_words"))


def lines_over_limits(docs: DataFrame) -> DataFrame:
    """(doc_id, twin, host, pos, words): the lines (from 0) of each different row that are above the limits.

    Lines go by a 64-bit hash of their normalised form. Documents are distinct pairs of doc_id and text, so a repeated row
    counts once; counts are partial sums by (host, line, document) first, so neither a hot host nor a hot line meets in
    one task before.
    """
    t = keyed(docs).select(*KEY, F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(*KEY, "pos", normalised(F.col("line")).alias("line")).where("line <> ''")
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lines = cut(t.select(*KEY, "pos", F.xxhash64("line").alias("line"), words.cast("long").alias("words")))
    of_line = lines.groupBy("host", "line").agg(F.count_distinct("doc_id", "twin").alias("docs")).where(F.col("docs") >= LINE_DOCS)
    of_host = lines.groupBy("host").agg(F.count_distinct("doc_id", "twin").alias("all_docs"))
    frequent = of_line.join(of_host, "host").where(F.col("docs") > LINE_PART * F.col("all_docs")).select("host", "line")
    return lines.join(frequent, ["host", "line"]).select(*KEY, "pos", "words").distinct()


def judged(docs: DataFrame) -> DataFrame:
    """A row (doc_id, twin, host, the base counts, base_failed, left_words, depleted, kept, gone) per row of docs; gone: places of lines above the limits."""
    gone = lines_over_limits(docs).groupBy(*KEY).agg(F.sum("words").alias("words"), F.collect_set("pos").alias("gone"))
    # cut here: a filter on kept would else be pushed below the counts, and copy their expressions many times over
    base = cut(base_counts(docs)).join(gone, KEY, "left")
    base = base.withColumn("left_words", F.col("n_words") - F.coalesce("words", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PART * F.col("n_words"))
    depleted = (F.col("left_words") < LEFT_WORDS) | (F.col("left_words") < LEFT_PART * F.col("n_words"))
    return base.withColumns({"base_failed": failed, "depleted": depleted, "kept": ~failed & ~depleted}).drop("words")


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, source): the base counts, base_failed, left_words, depleted and kept.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows. A line is over the limits if at
    least LINE_DOCS documents of its host (source) have it and over LINE_PART of the host's documents; left_words are
    the words outside such lines; depleted: fewer than LEFT_WORDS or under LEFT_PART of the words are left. kept: neither.
    A null text is empty and fails, a null source is the host of an empty name, a null doc_id stays null, repeated rows
    have equal results each, an empty table gives none, and other columns aren't read.
    """
    return judged(docs).select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "left_words", "depleted", "kept"
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their own columns, without the lines above the limits (n_chars follows)."""
    verdicts = judged(docs).where("kept").select(*(F.col(k).alias(f"__{k}") for k in KEY), F.col("gone").alias("__gone")).dropDuplicates([f"__{k}" for k in KEY])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.withColumns({"__doc_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "__twin": F.xxhash64(text), "__host": F.coalesce(F.col("source").cast("string"), F.lit(""))})
    own = own.join(verdicts, [f"__{k}" for k in KEY])
    left = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("__gone", i)), "\n"))
    own = own.withColumn("text", left)
    return own.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))
