"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, embed_dedup, html_text, ngram_join, packing, phrases, pii, piece_codec, quality, secrets, suffix_dedup, token_files


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.best_fit_pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return placed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(own)
    return chat.read_back(chat.prefix_targets(turns))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    made = piece_codec.decode_pieces(piece_codec.encode_pieces(table(spark, sf_dir, "documents"), model), model)
    return made.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_classes(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_chat_formatting, op3_quality_rules, op4_sentencepiece, op5_ngram_jaccard_join, op6_suffix_array_dedup, op7_embedding_near_dedup,
    op8_html_extraction, op9_secret_scans, op10_token_output, op11_phrase_collocations,
    op12_cross_tokenizer_alignment, op13_pii, pipeline,
)}

ORACLES: dict[str, str] = {}

ORACLES["op2_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, role = 'assistant' AS reply, length(CASE WHEN role = 'assistant' THEN regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g') || '</s>'
    ELSE '[INST] ' || regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '([\[<])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g') || chr(10) || regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g') || ' [/INST]' END) AS n
  FROM t
), w AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS e,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last FROM s
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN reply THEN length(text) END), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(CASE WHEN reply THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(CASE WHEN reply OR last THEN e END)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""

ORACLES["op3_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT r, doc_id, text, host, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS w, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (SELECT r, doc_id, host, text, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM d),
full_lines AS (SELECT * FROM lines WHERE line <> ''),
frequent AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT (doc_id, text)) AS n FROM full_lines GROUP BY host, line) JOIN (SELECT host, count(DISTINCT (doc_id, text)) AS m FROM full_lines GROUP BY host) USING (host)
  WHERE n >= {quality.LINE_DOCS} AND n > {quality.LINE_PART}::DOUBLE * m),
gone AS (SELECT r, sum(len(string_split(line, ' ')))::BIGINT AS n FROM full_lines JOIN frequent USING (host, line) GROUP BY r),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, (len(w) - coalesce(gone.n, 0))::BIGINT AS left_words
  FROM w LEFT JOIN covered USING (r) LEFT JOIN gone USING (r)),
v AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PART} * n_words AS base_failed, left_words < {quality.LEFT_WORDS} OR left_words < {quality.LEFT_PART}::DOUBLE * n_words AS depleted FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, left_words, depleted, NOT base_failed AND NOT depleted AS kept FROM v
"""

ORACLES["op5_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS to_id FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.to_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(to_id) AS m FROM r GROUP BY doc_id) c USING (doc_id)
"""

ORACLES["op7_embedding_near_dedup"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT a AS vec_id, b AS to_id FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.to_id)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(c.m, v.vec_id)) AS component_id, least(v.vec_id, coalesce(c.m, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) n USING (vec_id) LEFT JOIN (SELECT vec_id, min(to_id) AS m FROM r GROUP BY vec_id) c USING (vec_id)
"""


def _secrets_sql() -> str:
    """Matches by splitting the text at them, as (doc, place, kind); DuckDB has no positions either."""
    parts = []
    for i, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT r, {i} AS o, '{r.kind}' AS kind, {str(r.base).lower()} AS base, a, a + length(h) AS b, length(k) AS k, {r.least} AS least FROM (
  SELECT r, h[j] AS h, k[j] AS k, list_sum([length(x) FOR x IN g[1:j]]) + coalesce(list_sum([length(x) FOR x IN h[1:j - 1]]), 0) AS a FROM (
    SELECT *, unnest(range(1, len(h) + 1)) AS j FROM (SELECT r, regexp_extract_all(text, '{p}') AS h, regexp_extract_all(text, '{p}', {r.group}) AS k, regexp_split_to_array(text, '{p}') AS g FROM d WHERE regexp_matches(text, '{p}'))))""")
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), s AS ({' UNION ALL '.join(parts)}), f AS (SELECT * FROM s WHERE k >= least),
t AS (SELECT r, {', '.join(f"count(*) FILTER (kind = '{x.kind}') AS n_{x.kind}" for x in secrets.RULES if x.base)}, string_agg(CASE WHEN base THEN kind || ':' || a::BIGINT || ':' || b::BIGINT END, ',' ORDER BY a, o) AS own, string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, o) AS spans FROM f GROUP BY r)
SELECT doc_id, {', '.join(f"coalesce(n_{x.kind}, 0) AS n_{x.kind}" for x in secrets.RULES if x.base)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (r)"""


ORACLES["op9_secret_scans"] = _secrets_sql()

ORACLES["op11_phrase_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, [x FOR x IN regexp_split_to_array(p, '[\x20\x09]+') IF x <> ''] AS w FROM d),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, w, count(*) AS a FROM (SELECT lang, w[i:i + k - 1] AS w FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)) GROUP BY lang, w),
c AS (SELECT * FROM f WHERE len(w) > 1 AND a >= 30),
cuts AS (SELECT lang, w, a, k, w[1:k] AS x, w[k + 1:] AS y FROM (SELECT *, unnest(range(1, len(w))) AS k FROM c)),
scored AS (SELECT cuts.lang, cuts.w, cuts.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * cuts.a) // (l.a + r.a) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.w = x JOIN f r ON r.lang = cuts.lang AND r.w = y),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
parts AS (SELECT lang, w, a, n, unnest(range(1, len(w) - n + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS n) WHERE n < len(w)),
within AS (SELECT lang, w[i:i + n - 1] AS w, max(a) AS longer FROM parts GROUP BY 1, 2),
kept AS (SELECT weakest.* FROM weakest LEFT JOIN within USING (lang, w) WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (SELECT *, array_to_string(w, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
