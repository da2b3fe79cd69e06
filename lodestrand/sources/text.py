"""Readers of text formats. Every reader is a scan of lines and built-in functions, so files split and filters apply early."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BED = ("chrom", "start", "end", "name", "score", "strand")
GTF = ("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")
VCF = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")
FIMO = ("motif_id", "motif_alt_id", "sequence_name", "start", "stop", "strand", "score", "p_value", "q_value", "matched_sequence")


def existing(paths: list[str]) -> list[str]:
    """Of local paths those that exist; a missing file is left out, not an error."""
    return [p for p in paths if "://" in p or os.path.exists(p)]


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths)


def fields(df: DataFrame, names: tuple[str, ...], separator: str = "\t", least: int = 1, comment: str = "#", whole: tuple[str, ...] = ()) -> DataFrame:
    """Named string columns of delimited lines; comments, blank lines and lines with fewer than `least` fields go."""
    part = F.split("value", separator, -1)
    kept = df.where((F.trim("value") != "") & ~F.startswith("value", F.lit(comment)))
    kept = kept.select(*whole, part.alias("f")).where(F.size("f") >= least)
    return kept.select(*whole, *(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)))


def delimited(spark: SparkSession, paths, schema: str, separator: str = "\t", header: bool = True, comment: str | None = None) -> DataFrame:
    """CSV/TSV with an explicit schema."""
    reader = spark.read.schema(schema).option("sep", separator).option("header", header)
    return (reader.option("comment", comment) if comment else reader).csv(paths)


def whitespace_table(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Fields parted by any run of white space."""
    return fields(df.select(F.trim("value").alias("value")), names, r"\s+")


def attributes(column: Column, quoted: bool = True) -> Column:
    """GTF attributes `key "value"; ...`, or `key=value;...`, as a map; the last of equal keys stays."""
    parts = F.filter(F.transform(F.split(column, ";"), lambda x: F.trim(x)), lambda x: x != "")
    key = lambda x: F.regexp_extract(x, r"^([^\s=]+)", 1)
    value = lambda x: F.trim(F.regexp_replace(x, r"^[^\s=]+[\s=]*", ""))
    strip = (lambda v: F.regexp_replace(v, r'^"|"$', "")) if quoted else (lambda v: v)
    pairs = F.transform(parts, lambda x: F.struct(key(x).alias("key"), strip(value(x)).alias("value")))
    # the last of equal keys wins: drop pairs whose key comes again later
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def gtf(df: DataFrame, zero_based: bool = False) -> DataFrame:
    """GTF/GFF lines with 9 fields (S3-S5): start and end as longs, attributes as the map attrs; zero_based: BED coordinates."""
    out = fields(df, GTF, least=9)
    return out.withColumns({"start": F.expr(f"try_cast(start AS BIGINT) - {int(zero_based)}"), "end": F.expr("try_cast(`end` AS BIGINT)"), "attrs": attributes(F.col("attributes"))})


def bed(df: DataFrame) -> DataFrame:
    """BED lines with 3 to 6 fields (S6); absent ones are null."""
    return fields(df, BED, least=3).withColumns({"start": F.expr("try_cast(start AS BIGINT)"), "end": F.expr("try_cast(`end` AS BIGINT)")}).where("start IS NOT NULL AND `end` IS NOT NULL")


def fasta(spark: SparkSession, paths) -> DataFrame:
    """(id, description, seq) of FASTA records (S7); Spark splits the file at lines that begin with `>`."""
    records = spark.read.option("lineSep", "\n>").text(paths).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)")
    return records.select(F.regexp_extract(head, r"^(\S+)", 1).alias("id"), F.trim(head).alias("description"), F.regexp_replace(body, r"\s", "").alias("seq"))


def header_interval(column: Column) -> Column:
    """`chr:start-end|species` as a struct."""
    part = lambda i: F.regexp_extract(column, r"^>?(\w+):(\d+)-(\d+)\|(\w+)", i)
    return F.struct(part(1).alias("chrom"), part(2).try_cast("bigint").alias("start"), part(3).try_cast("bigint").alias("end"), part(4).alias("species"))


def vcf(df: DataFrame) -> DataFrame:
    """VCF lines with 8 fields or more (S10, S11): POS as long, alleles as an array, INFO as the map info."""
    out = fields(df, VCF, least=8)
    return out.withColumns({"POS": F.expr("try_cast(POS AS BIGINT)"), "alleles": F.split("ALT", ","), "info": attributes(F.col("INFO"))})


def allele_frequency(info: Column) -> Column:
    """AF, or AC / AN; a value that isn't one number is null."""
    number = lambda k: F.try_element_at(info, F.lit(k)).try_cast("double")
    return F.coalesce(number("AF"), F.try_divide(number("AC"), number("AN")))


def fimo(df: DataFrame) -> DataFrame:
    """FIMO rows with coordinates."""
    out = fields(df, FIMO, least=9).where("motif_id <> 'motif_id'")
    return out.withColumns({c: F.expr(f"try_cast({c} AS BIGINT)") for c in ("start", "stop")} | {c: F.expr(f"try_cast({c} AS DOUBLE)") for c in ("score", "p_value", "q_value")}).na.drop(subset=["start", "stop"])


def coords(df: DataFrame) -> DataFrame:
    """MUMmer coordinates (S22): rows of 11 fields or more that begin with an integer; reverse hits keep S2 > E2."""
    names = ("S1", "E1", "S2", "E2", "LEN1", "LEN2", "IDY", "LENR", "LENQ", "RT", "QT")
    rows = df.where(F.col("value").rlike(r"^\s*\d+\s"))
    out = fields(rows.select(F.trim("value").alias("value")), names, r"\s+", 11)
    return out.select(*(F.expr(f"try_cast({c} AS {'DOUBLE' if c == 'IDY' else 'BIGINT'}) AS {c}") if c not in ("RT", "QT") else F.col(c) for c in names))


def distances(df: DataFrame, tool: str) -> DataFrame:
    """Mash (third field from the end) or Dashing2 (third field) distances, with the line's place lost."""
    part = F.split(F.trim("value"), r"\s+")
    at = F.try_element_at(part, F.lit(-3 if tool == "mash" else 3))
    return df.select(F.get(part, F.lit(0)).alias("ref"), F.get(part, F.lit(1)).alias("query"), at.try_cast("double").alias("distance")).where("distance IS NOT NULL")


def training_log(df: DataFrame) -> DataFrame:
    """epoch, and any `name: number` of lines that start with Epoch."""
    number = lambda name: F.regexp_extract("value", rf"\b{name}:\s*(-?[0-9.]+(?:[eE][-+]?\d+)?)", 1).try_cast("double").alias(name)
    return df.where(F.startswith("value", F.lit("Epoch"))).select(F.regexp_extract("value", r"^Epoch\s+(\d+)", 1).try_cast("int").alias("epoch"), *map(number, ("loss", "valid_loss", "valid_r")))


def html_rows(df: DataFrame, column: str = "value", cell: str = "t[dh]") -> DataFrame:
    """(row_no, cells) for each <tr> of a page in `column` (S19); cells without tags, trimmed."""
    rows = F.regexp_extract_all(column, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(F.regexp_extract_all("row", F.lit(rf"(?is)<{cell}\b[^>]*>(.*?)</{cell}>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"<[^>]*>", "")))
    return df.select("*", F.posexplode(rows).alias("row_no", "row")).select(*[c for c in df.columns if c != column], "row_no", cells.alias("cells"))


def xml_scalar(column, tag: str) -> Column:
    """The text of the first <tag> of an XML document, null if there is none."""
    found = F.xpath_string(column, F.lit(f"//{tag}[1]"))
    return F.when(found != "", found)


def json_keys(column) -> Column:
    """The keys of a JSON object in order (S27); null if it is none."""
    return F.json_object_keys(column)


def newick_edges(text: str) -> list[tuple[int, int, str, float | None]]:
    """(node, parent, name, length) of a Newick tree, the root's parent is -1 (S29). A tree is metadata and fits the driver."""
    out: list[list] = [[0, -1, "", None]]
    at, token = 0, ""

    def label(s: str) -> None:
        name, _, length = s.strip().partition(":")
        out[at][2] = name.strip("'\"")
        out[at][3] = float(length) if length.strip() else None

    for c in text.strip():
        if c == "(":
            out.append([len(out), at, "", None])
            at, token = len(out) - 1, ""
        elif c in ",);":
            label(token)
            token = ""
            if c == ";":
                break
            at = out[at][1]
            if c == ",":
                out.append([len(out), at, "", None])
                at = len(out) - 1
        else:
            token += c
    return [tuple(x) for x in out]


def sections(df: DataFrame, marker: str, order: str = "n") -> DataFrame:
    """Lines (order, value) with in_section: whether a line that starts with `marker` came before."""
    from pyspark.sql import Window

    seen = F.max(F.startswith("value", F.lit(marker)).cast("int")).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("in_section", F.coalesce(seen, F.lit(0)) == 1)


def write_delimited(df: DataFrame, path: str, separator: str = "\t") -> None:
    """CSV/TSV with a header (K1)."""
    df.write.option("sep", separator).option("header", True).csv(path)


def bed_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in df.columns)).alias("value"))


def write_bed(df: DataFrame, path: str, label: str, union: str = "all") -> None:
    """BED lines of df's other columns, a folder for each label and one, `union`, for all rows together (K2); one job, one pass."""
    columns = [c for c in df.columns if c != label]
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns)).alias("value")
    df.select(line, F.explode(F.array(F.col(label).cast("string"), F.lit(union))).alias(label)).write.partitionBy(label).text(path)


def named_or_placed(spark: SparkSession, paths, column: str, place: int, comment: str = "!", separator: str = "\t") -> DataFrame:
    """(file, value): one field of each line that is no comment.

    A file with a line that has a field `column` names it there: that line goes, and its place counts. In other files
    the field at `place` counts, and every line stays. Lines that are too short have no row.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value").where(~F.startswith("value", F.lit(comment)) & (F.trim("value") != ""))
    lines = lines.select("file", F.split("value", separator).alias("f"))
    at = (F.array_position("f", F.lit(column)) - 1).cast("int")
    named = lines.where(at >= 0).groupBy("file").agg(F.min(at).alias("at"))
    return lines.where(at < 0).join(named, "file", "left").select("file", F.get("f", F.coalesce("at", F.lit(place))).alias("value")).where("value IS NOT NULL")


def vcf_lines(df: DataFrame) -> DataFrame:
    """Body lines of a VCF from chrom, pos, ref, alt; rows without a position or allele go (K3)."""
    dot = F.lit(".")
    return df.na.drop(subset=["chrom", "pos", "ref", "alt"]).select(F.concat_ws("\t", "chrom", "pos", dot, "ref", "alt", dot, dot, dot).alias("value"))


def fasta_lines(df: DataFrame) -> DataFrame:
    """Two lines for each record of df(id, seq) (K4)."""
    return df.select(F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("value"))


def meme_lines(matrix: list[list[float]], name: str) -> str:
    """A motif in MEME text (K7)."""
    rows = "\n".join(" ".join(f"{x:.6f}" for x in r) for r in matrix)
    return f"MEME version 4\n\nALPHABET= ACGT\n\nMOTIF {name}\nletter-probability matrix: alength= 4 w= {len(matrix)}\n{rows}\n"


def meme(spark: SparkSession, paths) -> DataFrame:
    """(name, width, matrix) of the motifs in MEME text (S21); Spark splits files at lines that begin with `MOTIF `.

    The header line gives the width; so many of the number rows after it are the matrix. A motif without a header is left out.
    """
    records = spark.read.option("lineSep", "\nMOTIF ").text(paths).select(F.regexp_replace("value", "^MOTIF ", "").alias("value"))
    body = F.split(F.regexp_replace("value", r"(?s)^.*?\nletter-probability matrix[^\n]*\n", ""), "\n")
    rows = F.filter(F.transform(body, lambda x: F.trim(x)), lambda x: x.rlike(r"^[-+0-9.eE]+(\s+[-+0-9.eE]+)+$"))
    out = records.where(F.col("value").rlike(r"\nletter-probability matrix")).select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("name"), F.regexp_extract("value", r"\nletter-probability matrix[^\n]*\bw= *([0-9]+)", 1).cast("int").alias("width"), rows.alias("r"))
    return out.select("name", "width", F.transform(F.slice("r", 1, F.col("width")), lambda x: F.split(x, r"\s+").cast("array<double>")).alias("matrix"))


def meme_records(df: DataFrame) -> DataFrame:
    """A value for each motif of df(name, matrix), with the line end that parts it from the next (K7): a text sink writes a library."""
    numbers = F.array_join(F.transform("matrix", lambda r: F.array_join(F.transform(r, lambda x: F.format_string("%.6f", x)), " ")), "\n")
    return df.select(F.concat(F.lit("MOTIF "), "name", F.lit("\nletter-probability matrix: alength= 4 w= "), F.size("matrix").cast("string"), F.lit("\n"), numbers, F.lit("\n")).alias("value"))
