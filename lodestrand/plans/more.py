"""More queries of the inventory, registered beside those of `inventory` and over the same stand-ins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import intervals as I  # noqa: E741
from ..operators import metrics as M
from ..operators import tracks as K
from ..operators import windows as W
from ..sources import text as X
from .inventory import COVERED, HITS, OVER, PEAKS, SCORED, SPANS, STEPS, Tables, both, query

ID = ["chrom", "start", "end", "id", "line"]


def rounded(*names: str, to: int = 6):
    return [F.round(n, to).alias(n) for n in names]


# regions, tracks, intervals
@query("a17_region_scores", f"""WITH {PEAKS}, a AS (SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM peaks p WHERE {OVER})) AS tp FROM hits h),
  b AS (SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM hits h WHERE {OVER})) AS tp FROM peaks p)
  SELECT round(a.tp / a.n, 6) AS precision, round(b.tp / b.n, 6) AS recall, round(2 * (a.tp / a.n) * (b.tp / b.n) / (a.tp / a.n + b.tp / b.n), 6) AS f1, round(a.tp / (a.n + b.n - a.tp), 6) AS jaccard FROM a, b""")
def region_scores(t: Tables):
    found = lambda x, y, n: I.overlap_flag(x, y, ID, 64).agg(F.count_if("overlaps").alias(n), F.count("*").alias(f"n_{n}"))
    one = found(t.hits, t.peaks, "a").crossJoin(found(t.peaks, t.hits, "b"))  # one row each
    return one.select(*(F.round(c, 6).alias(k) for k, c in M.region_scores(F.col("a"), F.col("n_a"), F.col("b"), F.col("n_b")).items()))


@query("a15_jaccard", f"""WITH {PEAKS}, x AS ({COVERED} hits), y AS ({COVERED} peaks), i AS (SELECT count(*) AS n FROM x JOIN y USING (chrom, x)) SELECT round(i.n / ((SELECT count(*) FROM x) + (SELECT count(*) FROM y) - i.n), 8) AS jaccard FROM i""")
def base_jaccard(t: Tables):
    a, b = I.merged(t.hits), I.merged(t.peaks)
    size = lambda df, n: df.agg(F.sum(F.col("end") - F.col("start")).alias(n))
    shared = I.clipped(I.overlap_join(a, b, 64)).agg(F.sum(F.col("clip_end") - F.col("clip_start")).alias("both"))
    return shared.crossJoin(size(a, "x")).crossJoin(size(b, "y")).select(F.round(F.col("both") / (F.col("x") + F.col("y") - F.col("both")), 8).alias("jaccard"))


@query("w9_breakpoints", f"""WITH {PEAKS}, x AS (SELECT chrom, x, count(*) AS a FROM (SELECT chrom, unnest(range(start, "end")) AS x FROM hits) GROUP BY 1, 2), y AS (SELECT chrom, x, count(*) AS b FROM (SELECT chrom, unnest(range(start, "end")) AS x FROM peaks) GROUP BY 1, 2)
  SELECT chrom, coalesce(a, 0)::BIGINT AS a, coalesce(b, 0)::BIGINT AS b, count(*) AS bp FROM x FULL JOIN y USING (chrom, x) GROUP BY 1, 2, 3""")
def breakpoints(t: Tables):
    return K.breakpoints(t.hits, t.peaks).groupBy("chrom", "a", "b").agg(F.sum(F.col("end") - F.col("start")).alias("bp"))


@query("a37_fold_enrichment", f"""WITH {PEAKS}, x AS (SELECT chrom, x, count(*) AS a FROM (SELECT chrom, unnest(range(start, "end")) AS x FROM hits) GROUP BY 1, 2), y AS (SELECT chrom, x, count(*) AS b FROM (SELECT chrom, unnest(range(start, "end")) AS x FROM peaks) GROUP BY 1, 2)
  SELECT chrom, round(sum(greatest(log10((coalesce(a, 0) + 1) / (coalesce(b, 0) + 1)), 0)), 4) AS total FROM x FULL JOIN y USING (chrom, x) GROUP BY 1""")
def enrichment(t: Tables):
    size = F.col("end") - F.col("start")
    return K.breakpoints(t.hits, t.peaks).groupBy("chrom").agg(F.round(F.sum(size * K.fold_enrichment(F.col("a"), F.col("b"))), 4).alias("total"))


@query("j28_peak_mask", f"""WITH {PEAKS}, x AS ({COVERED} hits), y AS ({COVERED} peaks) SELECT chrom, count(*) FILTER (y.x IS NOT NULL) AS masked, count(*) FILTER (y.x IS NULL) AS free FROM x LEFT JOIN y USING (chrom, x) GROUP BY chrom""")
def peak_mask(t: Tables):
    size = F.col("end") - F.col("start")
    return K.breakpoints(I.merged(t.hits), I.merged(t.peaks)).where("a > 0").groupBy("chrom").agg(F.coalesce(F.sum(F.when(F.col("b") > 0, size)), F.lit(0)).alias("masked"), F.coalesce(F.sum(F.when(F.col("b") == 0, size)), F.lit(0)).alias("free"))


@query("j26_region_hits", f"""WITH {HITS}, r AS (SELECT s_suppkey % 25 AS chrom, s_suppkey * 3 AS start, s_suppkey * 3 + 40 AS "end", s_suppkey FROM supplier) SELECT s_suppkey, count(*) AS n, min(h.start) AS first FROM r JOIN hits h ON h.chrom = r.chrom AND h."end" > r.start AND h.start < r."end" GROUP BY 1""")
def region_hits(t: Tables):
    regions = t.supplier.select((F.col("s_suppkey") % 25).alias("chrom"), (F.col("s_suppkey") * 3).alias("start"), (F.col("s_suppkey") * 3 + 40).alias("end"), "s_suppkey")
    return I.overlap_join(regions, t.hits, 64).groupBy("s_suppkey").agg(F.count("*").alias("n"), F.min("start_b").alias("first"))


@query("w11_sampled_windows", f"""WITH {PEAKS}, h AS (SELECT chrom, greatest(start - 50, 0) AS start, "end" + 50 AS "end", id, line FROM hits h ORDER BY md5('42:' || (id * 10 + line)), h.start, chrom LIMIT 20) SELECT h.id, h.line, h.start, count(p.id) AS n FROM h LEFT JOIN peaks p ON {OVER} GROUP BY h.chrom, 1, 2, 3""")
def sampled_windows(t: Tables):
    some = t.hits.withColumn("k", F.col("id") * 10 + F.col("line")).orderBy(W.hash_order("k"), "start", "chrom").limit(20)
    around = some.select("chrom", F.greatest(F.col("start") - 50, F.lit(0)).alias("start"), (F.col("end") + 50).alias("end"), "id", "line")
    key = ["chrom", "id", "line", "start"]
    n = I.overlap_join(around, t.peaks, 64).groupBy(*key).agg(F.count("*").alias("n"))
    return around.select(*key).join(n, key, "left").select("id", "line", "start", F.coalesce("n", F.lit(0)).alias("n"))


@query("f13_fraction_windows", f"""WITH {PEAKS}, h AS (SELECT chrom, s AS start, s + 128 AS "end" FROM (SELECT chrom, unnest(range(0, max("end") - 127, 64)) AS s FROM spans GROUP BY chrom)), y AS (SELECT chrom, x FROM (SELECT chrom, unnest(range(start, "end")) AS x FROM peaks) GROUP BY 1, 2 HAVING count(*) > 10)
  SELECT chrom, start FROM h WHERE (SELECT count(*) FROM y WHERE y.chrom = h.chrom AND y.x >= h.start AND y.x < h."end") / 128 <= 0.6""")
def fraction_windows(t: Tables):
    """Windows of which at most 0.6 is covered by more than ten peaks."""
    windows = I.tiles(t.spans.groupBy("chrom").agg(F.max("end").alias("size")), 128, 64)
    deep = I.coverage(t.peaks).where("depth > 10").select("chrom", "start", "end")
    part = I.clipped(I.overlap_join(windows, deep, 128)).groupBy("chrom", "start").agg((F.sum(F.col("clip_end") - F.col("clip_start")) / 128).alias("part"))
    return windows.join(part.where("part > 0.6"), ["chrom", "start"], "left_anti").select("chrom", "start")


@query("r10_bins_over_exons", f"""WITH {HITS} SELECT DISTINCT id, b AS bin FROM (SELECT id, unnest(range(start // 16, ("end" - 1) // 16 + 1)) AS b FROM hits)""")
def bins_over_exons(t: Tables):
    return t.hits.select("id", F.explode(F.sequence(F.floor(F.col("start") / 16), F.floor((F.col("end") - 1) / 16))).alias("bin")).distinct()


@query("r4_clamped", f"""WITH {PEAKS}, h AS (SELECT chrom, start, "end", id, line, (id % 1000)::DOUBLE AS v FROM hits) SELECT id, line, CASE WHEN EXISTS (SELECT 1 FROM peaks p WHERE h.chrom = p.chrom AND h.start < p."end" + 20 AND p.start - 20 < h."end") THEN least(v, 300.0) ELSE v END AS v FROM h""")
def clamped(t: Tables):
    black = t.peaks.select("chrom", (F.col("start") - 20).alias("start"), (F.col("end") + 20).alias("end"))
    return I.overlap_flag(t.hits, black, ID, 64).select("id", "line", F.when(F.col("overlaps"), F.least((F.col("id") % 1000).cast("double"), F.lit(300.0))).otherwise((F.col("id") % 1000).cast("double")).alias("v"))


# joins and aggregates
@query("j21_matched_negatives", """WITH p AS (SELECT p_partkey AS id, p_brand AS k FROM part WHERE p_partkey % 7 = 0), c AS (SELECT p_partkey AS id, p_brand AS k FROM part WHERE p_partkey % 7 <> 0),
  x AS (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY md5('42:' || id), id) AS r FROM p), y AS (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY md5('42:' || id), id) AS r FROM c) SELECT x.id, x.k, y.id AS negative FROM x LEFT JOIN y ON x.k = y.k AND x.r = y.r""")
def matched(t: Tables):
    ids = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("k"))
    return K.matched_negatives(ids.where("id % 7 = 0"), ids, ["k"], "id").select("id", "k", "negative")


@query("j24_m21_distances", """WITH m AS (SELECT l_linenumber AS g, l_returnflag AS k, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT a.g AS a, b.g AS b, round(sqrt(sum((a.v - b.v) ** 2)), 6) AS distance FROM m a JOIN m b ON a.k = b.k AND a.g <= b.g GROUP BY 1, 2""")
def distances(t: Tables):
    m = t.lineitem.groupBy(F.col("l_linenumber").alias("g"), F.col("l_returnflag").alias("k")).agg(F.avg("l_quantity").alias("v"))
    pairs = m.alias("x").join(m.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.g") <= F.col("y.g")))
    return pairs.groupBy(F.col("x.g").alias("a"), F.col("y.g").alias("b")).agg(F.round(F.sqrt(F.sum(F.pow(F.col("x.v") - F.col("y.v"), 2))), 6).alias("distance"))


both("j27_aligned", lambda t: t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers")).join(t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers")), "k", "full"),
     "SELECT k, customers, suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) USING (k)")
both("a21_pivot_mean", lambda t: t.lineitem.groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity")).select("l_linenumber", *(F.round(c, 6).alias(c) for c in "ANR")),
     "SELECT l_linenumber, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS \"A\", round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS \"N\", round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS \"R\" FROM lineitem GROUP BY 1")
both("a27_best_then_folds", lambda t: t.orders.groupBy("o_orderpriority", "o_custkey").agg(F.min("o_totalprice").alias("best")).groupBy("o_orderpriority").agg(F.round(F.avg("best"), 4).alias("mean"), F.round(F.stddev_pop("best"), 4).alias("sd")),
     "SELECT o_orderpriority, round(avg(best), 4) AS mean, round(stddev_pop(best), 4) AS sd FROM (SELECT o_orderpriority, o_custkey, min(o_totalprice) AS best FROM orders GROUP BY 1, 2) GROUP BY 1")
both("a29_ensemble_mean", lambda t: t.lineitem.groupBy("l_suppkey", F.col("l_linenumber").alias("fold")).agg(F.avg("l_tax").alias("m")).groupBy("l_suppkey").agg(F.round(F.avg("m"), 8).alias("m"), F.count("*").alias("folds")),
     "SELECT l_suppkey, round(avg(m), 8) AS m, count(*) AS folds FROM (SELECT l_suppkey, l_linenumber, avg(l_tax) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
both("a28_first_position", lambda t: t.embeddings.select("vec_id", F.round(F.aggregate(F.col("embedding"), F.lit(0.0), lambda a, x: a + x.cast("double"), lambda a: a / F.size("embedding")), 6).alias("mean"), F.array_max("embedding").alias("max"), F.get("embedding", F.lit(0)).alias("first")),
     "SELECT vec_id, round(list_sum([x::DOUBLE FOR x IN embedding]) / len(embedding), 6) AS mean, list_max(embedding) AS max, embedding[1] AS first FROM embeddings")
both("a9_confusion_all", lambda t: t.scored.groupBy("g").agg(*(F.count_if(((F.col("score") > 150) == p) & (F.col("label") == y)).alias(n) for n, p, y in (("tp", True, 1), ("fp", True, 0), ("fn", False, 1), ("tn", False, 0)))),
     f"WITH {SCORED} SELECT g, count(*) FILTER (score > 150 AND label = 1) AS tp, count(*) FILTER (score > 150 AND label = 0) AS fp, count(*) FILTER (score <= 150 AND label = 1) AS fn, count(*) FILTER (score <= 150 AND label = 0) AS tn FROM scored GROUP BY g")


@query("a31_set_jaccard", """WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), n AS (SELECT l_suppkey, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.l_suppkey AS x, b.l_suppkey AS y, count(*) AS o FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2)
  SELECT x, y, round(o / (a.n + b.n - o), 8) AS jaccard FROM p JOIN n a ON a.l_suppkey = x JOIN n b ON b.l_suppkey = y""")
def set_jaccard(t: Tables):
    s = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    n = s.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    met = s.alias("a").join(s.alias("b"), "l_orderkey").where("a.l_suppkey < b.l_suppkey").groupBy(F.col("a.l_suppkey").alias("x"), F.col("b.l_suppkey").alias("y")).agg(F.count("*").alias("o"))
    met = met.join(n.select(F.col("l_suppkey").alias("x"), F.col("n").alias("nx")), "x").join(n.select(F.col("l_suppkey").alias("y"), F.col("n").alias("ny")), "y")
    return met.select("x", "y", F.round(F.col("o") / (F.col("nx") + F.col("ny") - F.col("o")), 8).alias("jaccard"))


both("a33_positions", lambda t: K.numbered(t.lineitem.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("o"), "l_returnflag"), ["l_orderkey"], "o").groupBy("l_orderkey", "l_returnflag").agg(F.array_join(F.sort_array(F.collect_list("i")), ",").alias("places")),
     "SELECT l_orderkey, l_returnflag, string_agg(i, ',' ORDER BY i) AS places FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem) GROUP BY 1, 2")


@query("a35_aligned_fraction", "SELECT round((SELECT sum(l_quantity) FROM lineitem) / (SELECT sum(m) FROM (SELECT max(l_extendedprice) AS m FROM lineitem GROUP BY l_partkey)), 10) AS part")
def aligned_fraction(t: Tables):
    whole = t.lineitem.groupBy("l_partkey").agg(F.max("l_extendedprice").alias("m")).agg(F.sum("m").alias("m"))
    return t.lineitem.agg(F.sum("l_quantity").alias("q")).crossJoin(whole).select(F.round(F.col("q") / F.col("m"), 10).alias("part"))


@query("a40_to_shortest", """WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT i, round(avg(value), 6) AS mean, round(coalesce(stddev_pop(value), 0), 6) AS sd FROM e WHERE i < (SELECT min(n) FROM e) GROUP BY i""")
def to_shortest(t: Tables):
    return K.to_shortest(t.events.select("user_id", "event_id", "value"), ["user_id"], "event_id").groupBy("i").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"))


@query("a41_tree_predicates", """WITH e AS (SELECT 'r' || n_regionkey AS node, n_nationkey FROM nation UNION ALL SELECT 'n' || n_nationkey, n_nationkey FROM nation UNION ALL SELECT 'root', n_nationkey FROM nation)
  SELECT node, bool_and(c_acctbal > 0) AS all_leaves, bool_or(c_acctbal > 9000) AS any_leaf, count(*) AS leaves, CASE left(node, 1) WHEN 'n' THEN 2 ELSE CASE node WHEN 'root' THEN 0 ELSE 1 END END AS depth FROM e JOIN customer ON c_nationkey = n_nationkey GROUP BY node""")
def tree_predicates(t: Tables):
    """Root, regions, nations and customers are a tree: each leaf goes to its ancestors, then one aggregate."""
    above = t.nation.select("n_nationkey", F.explode(F.array(F.struct(F.lit("root").alias("node"), F.lit(0).alias("depth")), F.struct(F.concat(F.lit("r"), "n_regionkey").alias("node"), F.lit(1).alias("depth")), F.struct(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.lit(2).alias("depth")))).alias("a")).select("n_nationkey", "a.*")
    leaves = t.customer.join(F.broadcast(above), F.col("c_nationkey") == F.col("n_nationkey"))  # three rows for each of 25 nations
    return leaves.groupBy("node").agg(F.bool_and(F.col("c_acctbal") > 0).alias("all_leaves"), F.bool_or(F.col("c_acctbal") > 9000).alias("any_leaf"), F.count("*").alias("leaves"), F.min("depth").alias("depth"))


# motifs: l_suppkey is a motif, l_linenumber - 1 a position, a base each of three columns
MOTIF = "m AS (SELECT l_suppkey AS k, l_linenumber - 1 AS pos, sum(abs(l_discount)) + sum(abs(l_tax)) AS weight FROM lineitem GROUP BY 1, 2)"
BOUNDS = MOTIF + ", t AS (SELECT *, max(weight) OVER (PARTITION BY k) AS top, count(*) OVER (PARTITION BY k) AS size FROM m), b AS (SELECT k, greatest(min(pos) FILTER (weight >= top * 0.8) - 1, 0) AS trim_start, least(max(pos) FILTER (weight >= top * 0.8) + 2, min(size)) AS trim_end, min(size) AS size FROM t GROUP BY k)"


def motif(t: Tables):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("k"), (F.col("l_linenumber") - 1).alias("pos")).agg((C.exact_sum(F.abs("l_discount")) + C.exact_sum(F.abs("l_tax"))).alias("weight"))


both("a38_trim_bounds", lambda t: K.trim_bounds(motif(t), ["k"], 0.8, 1), f"WITH {BOUNDS} SELECT * FROM b")
both("a39_confidence", lambda t: motif(t).join(K.trim_bounds(motif(t), ["k"], 0.8, 1), "k").where("pos >= trim_start AND pos < trim_end").groupBy("k").agg(F.round(F.sum("weight"), 6).alias("confidence")),
     f"WITH {BOUNDS} SELECT k, round(sum(weight), 6) AS confidence FROM m JOIN b USING (k) WHERE pos >= trim_start AND pos < trim_end GROUP BY k")


@query("c27_seqlet_place", f"""WITH {BOUNDS} SELECT l_orderkey, l_linenumber, l_partkey + l_linenumber + CASE WHEN l_returnflag = 'R' THEN size - trim_end ELSE trim_start END AS start, l_partkey + l_linenumber + CASE WHEN l_returnflag = 'R' THEN size - trim_start ELSE trim_end END AS "end" FROM lineitem JOIN b ON k = l_suppkey""")
def seqlet_place(t: Tables):
    b = K.trim_bounds(motif(t), ["k"], 0.8, 1)
    start, end = K.seqlet_on_genome(F.col("l_partkey"), F.col("l_linenumber"), F.col("trim_start"), F.col("trim_end"), F.col("size"), F.col("l_returnflag") == "R")
    return t.lineitem.join(b, F.col("l_suppkey") == F.col("k")).select("l_orderkey", "l_linenumber", start.alias("start"), end.alias("end"))


# series
SERIES = "e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def series(t: Tables):
    return K.numbered(t.events.select("user_id", "event_id", "value"), ["user_id"], "event_id")


@query("w6_runs", """WITH a AS (SELECT user_id, event_id, value > 50 AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, value > 50 ORDER BY event_id) AS k FROM events) SELECT user_id, min(event_id) AS first, max(event_id) AS last, s AS state, count(*) AS n FROM a GROUP BY user_id, s, k""")
def state_runs(t: Tables):
    return K.runs(t.events.select("user_id", "event_id", (F.col("value") > 50).alias("state")), ["user_id"], "event_id", "state")


@query("w12_padded", f"WITH {SERIES} SELECT user_id, g AS i, coalesce(e.value, l.value) AS value FROM (SELECT DISTINCT user_id FROM e) CROSS JOIN (SELECT unnest(range(0, (SELECT max(n) FROM e))) AS g) LEFT JOIN e ON e.user_id = e_user AND e.i = g JOIN (SELECT user_id AS lu, arg_max(value, i) AS value FROM e GROUP BY 1) l ON l.lu = e_user".replace("SELECT DISTINCT user_id FROM e", "SELECT DISTINCT user_id AS e_user FROM e").replace("SELECT user_id, g AS i", "SELECT e_user AS user_id, g AS i"))
def padded(t: Tables):
    s = series(t)
    return K.padded(s, "user_id", "value", s.agg(F.max("n").alias("n")))


both("w13_trimmed_tail", lambda t: series(t).where("i < n - 3").select("event_id", "i"), f"WITH {SERIES} SELECT event_id, i FROM e WHERE i < n - 3")
both("w14_plot_rank", lambda t: t.customer.select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("r")), "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer")
both("w15_natural_order", lambda t: t.part.select("p_brand").distinct().select("p_brand", C.number_in(F.col("p_brand")).alias("key")), "SELECT DISTINCT p_brand, try_cast(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS key FROM part")


@query("w21_resampled", f"""WITH {SERIES}, c AS (SELECT user_id AS k, i / (n - 1) AS x, value AS y FROM e WHERE n > 1), grid AS (SELECT i / 10 AS g FROM range(11) t(i)), b AS (SELECT k, g, arg_max(x, x) FILTER (x <= g) AS x0, arg_max(y, x) FILTER (x <= g) AS y0, arg_min(x, x) FILTER (x >= g) AS x1, arg_min(y, x) FILTER (x >= g) AS y1 FROM c, grid GROUP BY 1, 2)
  SELECT k, g, round(CASE WHEN x0 = g THEN y0 ELSE y0 + (g - x0) / (x1 - x0) * (y1 - y0) END, 6) AS y FROM b""")
def resampled(t: Tables):
    curve = series(t).where("n > 1").select(F.col("user_id").alias("k"), (F.col("i") / (F.col("n") - 1)).alias("x"), F.col("value").alias("y"))
    return M.interpolated(curve, ["k"], t.spark.range(0, 11).select((F.col("id") / 10.0).alias("g"))).select("k", "g", F.round("y", 6).alias("y"))


# metrics
GRID = STEPS + ", c AS (SELECT g AS k, x, max(y) AS y FROM (SELECT g, fp / sum(q) OVER (PARTITION BY g) AS x, tp / sum(p) OVER (PARTITION BY g) AS y FROM st) GROUP BY 1, 2), grid AS (SELECT i / 10 AS g FROM range(11) t(i)), b AS (SELECT k, g, arg_max(x, x) FILTER (x <= g) AS x0, arg_max(y, x) FILTER (x <= g) AS y0, arg_min(x, x) FILTER (x >= g) AS x1, arg_min(y, x) FILTER (x >= g) AS y1 FROM c, grid GROUP BY 1, 2), v AS (SELECT k, g, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = g THEN y0 ELSE y0 + (g - x0) / (x1 - x0) * (y1 - y0) END AS y FROM b)"


@query("m4_curve_band", f"WITH {GRID} SELECT g, round(avg(y), 6) AS mean, round(stddev_samp(y) / sqrt(count(*)), 6) AS sem, round(greatest(avg(y) - stddev_samp(y) / sqrt(count(*)), 0), 6) AS low, round(least(avg(y) + stddev_samp(y) / sqrt(count(*)), 1), 6) AS high FROM v GROUP BY g HAVING count(*) >= 2")
def curve_band(t: Tables):
    curves = M.roc_curve(t.scored.withColumnRenamed("g", "k"), ["k"]).groupBy("k", F.col("fpr").alias("x")).agg(F.max("tpr").alias("y"))
    at = M.interpolated(curves, ["k"], t.spark.range(0, 11).select((F.col("id") / 10.0).alias("g")))
    return M.curve_band(at, "k").select("g", *rounded("mean", "sem", "low", "high"))


TAIL = "CASE WHEN {z} >= 0 THEN {p} ELSE 1 - {p} END"
POLY = "(1 / (1 + 0.2316419 * abs({z}))) * (0.319381530 + (1 / (1 + 0.2316419 * abs({z}))) * (-0.356563782 + (1 / (1 + 0.2316419 * abs({z}))) * (1.781477937 + (1 / (1 + 0.2316419 * abs({z}))) * (-1.821255978 + (1 / (1 + 0.2316419 * abs({z}))) * 1.330274429)))) * exp(-{z} * {z} / 2) / 2.5066282746310002"


def tail(z: str) -> str:
    return TAIL.format(z=z, p=POLY.format(z=z))


both("m11_p_values", lambda t: M.mann_whitney(t.scored, ["g"]).select("g", *rounded("p_greater", "p_less", "p_two_sided")),
     f"WITH {SCORED}, r AS (SELECT g, label, rank() OVER (PARTITION BY g ORDER BY score) + (count(*) OVER (PARTITION BY g, score) - 1) / 2 AS r, count(*) OVER (PARTITION BY g, score) AS t FROM scored), a AS (SELECT g, sum(label)::DOUBLE AS n1, count(*)::DOUBLE AS n, sum(CASE WHEN label = 1 THEN r END) AS r1, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY g), u AS (SELECT g, r1 - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2 AS d, sqrt(n1 * (n - n1) / 12 * ((n + 1) - ties / (n * (n - 1)))) AS s FROM a), z AS (SELECT g, (d - 0.5) / s AS zg, (-d - 0.5) / s AS zl, (abs(d) - 0.5) / s AS zt FROM u) SELECT g, round({tail('zg')}, 6) AS p_greater, round({tail('zl')}, 6) AS p_less, round(least(2 * ({tail('zt')}), 1), 6) AS p_two_sided FROM z")
both("m12_p_value", lambda t: M.kolmogorov_smirnov(t.scored, ["g"]).select("g", *rounded("p")),
     f"WITH {SCORED}, a AS (SELECT g, score, sum(label) AS p, sum(1 - label) AS q FROM scored GROUP BY 1, 2), c AS (SELECT g, sum(p) OVER (PARTITION BY g) AS n1, sum(q) OVER (PARTITION BY g) AS n0, abs(sum(p) OVER w / sum(p) OVER (PARTITION BY g) - sum(q) OVER w / sum(q) OVER (PARTITION BY g)) AS d FROM a WINDOW w AS (PARTITION BY g ORDER BY score ROWS UNBOUNDED PRECEDING)), x AS (SELECT g, max(d) * sqrt(max(n1) * max(n0) / (max(n1) + max(n0))) AS x FROM c GROUP BY g) SELECT g, round(greatest(least(2 * list_sum([CASE k % 2 WHEN 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * x * x) FOR k IN range(1, 21)]), 1), 0), 6) AS p FROM x")
both("m14_ecdf", lambda t: W.pct_rank_first(t.scored.select("g", "score", "o_orderkey"), ["g"], "score", "o_orderkey", "ecdf").groupBy("g", "score").agg(F.round(F.max("ecdf"), 8).alias("ecdf")),
     f"WITH {SCORED} SELECT DISTINCT g, score, round(cume_dist() OVER (PARTITION BY g ORDER BY score), 8) AS ecdf FROM scored")


@query("m17_quantile_normalised", """WITH m AS (SELECT l_suppkey AS gene, l_linenumber AS track, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY v, gene) AS k FROM m), q AS (SELECT k, avg(v) AS q FROM r GROUP BY k) SELECT gene, track, round(q - avg(q) OVER (PARTITION BY gene), 4) + 0.0 AS v FROM r JOIN q USING (k)""")
def quantile_normalised(t: Tables):
    m = t.lineitem.groupBy(F.col("l_suppkey").alias("gene"), F.col("l_linenumber").alias("track")).agg(C.exact_avg(F.col("l_extendedprice")).alias("v"))
    ranked = W.rank_first(m, ["track"], "v", "gene", "k")
    mean = ranked.groupBy("k").agg(F.avg("v").alias("q"))
    return ranked.join(mean, "k").select("gene", "track", (F.round(F.col("q") - F.avg("q").over(Window.partitionBy("gene")), 4) + 0.0).alias("v"))


both("m18_accuracy", lambda t: t.customer.agg(F.round(F.avg(F.when((F.col("c_acctbal") >= 0) == (F.col("c_nationkey") % 10 != 0), 1.0).otherwise(0.0)), 8).alias("accuracy")), "SELECT round(avg(CASE WHEN (c_acctbal >= 0) = (c_nationkey % 10 <> 0) THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM customer")


@query("m19_index_sets", "WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.08), i AS (SELECT count(*) AS n FROM a JOIN b USING (l_partkey)) SELECT round(i.n / (SELECT count(*) FROM a), 8) AS precision, round(i.n / (SELECT count(*) FROM b), 8) AS recall FROM i")
def index_sets(t: Tables):
    flags = t.lineitem.groupBy("l_partkey").agg(F.bool_or(F.col("l_quantity") > 45).alias("a"), F.bool_or(F.col("l_discount") > 0.08).alias("b"))
    both_ = F.count_if(F.col("a") & F.col("b"))
    return flags.agg(F.round(both_ / F.count_if("a"), 8).alias("precision"), F.round(both_ / F.count_if("b"), 8).alias("recall"))


both("m25_perplexity", lambda t: t.lineitem.groupBy("l_returnflag").agg(F.round(F.exp(F.avg("l_tax")), 8).alias("perplexity")), "SELECT l_returnflag, round(exp(avg(l_tax)), 8) AS perplexity FROM lineitem GROUP BY 1")
both("m24_tolerance", lambda t: M.verdict(t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, "ge").when(F.col("l_linenumber") == 2, "le").otherwise("approx").alias("mode"), F.col("l_tax").alias("reported"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("reproduced"), F.lit(0.1).alias("rtol"), F.lit(0.005).alias("atol"))).groupBy("mode", "verdict").agg(F.count("*").alias("n")),
     "SELECT mode, CASE WHEN b IS NULL THEN 'MISSING' WHEN CASE mode WHEN 'ge' THEN b >= a WHEN 'le' THEN b <= a ELSE abs(b - a) <= 0.005::DOUBLE + 0.1::DOUBLE * abs(a) END THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) AS n FROM (SELECT CASE l_linenumber WHEN 1 THEN 'ge' WHEN 2 THEN 'le' ELSE 'approx' END AS mode, l_tax AS a, CASE WHEN l_discount > 0 THEN l_discount END AS b FROM lineitem) GROUP BY 1, 2")

# order, limits, categories
both("o1_sorted", lambda t: t.nation.orderBy(F.desc("n_regionkey"), "n_name").select("n_regionkey", "n_name"), "SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name")
both("o2_chromosome_order", lambda t: t.lineitem.select(C.chromosome_order(F.concat(F.lit("chr"), (F.col("l_suppkey") % 20).cast("string"))).alias("o")).groupBy("o").agg(F.count("*").alias("n")), "SELECT CASE WHEN l_suppkey % 20 BETWEEN 1 AND 16 THEN (l_suppkey % 20)::INT END AS o, count(*) AS n FROM lineitem GROUP BY 1")
both("o4_largest_places", lambda t: t.embeddings.select("vec_id", F.array_join(F.transform(F.slice(F.array_sort(F.transform("embedding", lambda x, i: F.struct(-F.abs(x), i.alias("i")))), 1, 5), lambda s: s["i"].cast("string")), ",").alias("places")),
     "SELECT vec_id, array_to_string([(x.i)::VARCHAR FOR x IN list_sort([{'a': -abs(embedding[k]), 'i': k - 1} FOR k IN range(1, len(embedding) + 1)])[1:5]], ',') AS places FROM embeddings")
both("o5_limit", lambda t: t.customer.orderBy("c_custkey").limit(10).select("c_custkey"), "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10")
both("o8_parts", lambda t: K.numbered(t.customer.select("c_custkey", "c_nationkey"), ["c_nationkey"], "c_custkey").select("c_custkey", F.floor(F.col("i") / 10).alias("part")), "SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 10 AS part FROM customer")
both("o10_systematic_sample", lambda t: K.numbered(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey").where("i % 7 = 0 AND i < 140").select("o_orderkey"), "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 7 = 0 AND i < 140")
both("p5_reordered", lambda t: t.customer.join(F.broadcast(t.spark.createDataFrame([("MACHINERY", 0), ("BUILDING", 1)], "c_mktsegment string, place int")), "c_mktsegment", "left").groupBy("c_mktsegment", "place").agg(F.count("*").alias("n")).orderBy("place"), "SELECT c_mktsegment, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 END AS place, count(*) AS n FROM customer GROUP BY 1, 2")
both("f16_keep_flag", lambda t: t.part.select("p_partkey", C.level_of(F.col("p_name"), {"e": 3, "a": 2, "o": 1}).alias("level")).select("p_partkey", "level", (F.col("level") >= 2).alias("keep")), "SELECT p_partkey, level, level >= 2 AS keep FROM (SELECT p_partkey, CASE WHEN contains(p_name, 'e') THEN 3 WHEN contains(p_name, 'a') THEN 2 WHEN contains(p_name, 'o') THEN 1 ELSE 0 END AS level FROM part)")
both("f17_near_zero", lambda t: t.lineitem.where(F.abs(F.col("l_tax") - F.col("l_discount")) <= 0.005).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey"), "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE abs(l_tax - l_discount) <= 0.005")

# scalar functions
both("c1_c2_c3_names", lambda t: t.nation.select("n_nationkey", C.canonical_chromosome(F.concat(F.lit("chromosome"), "n_nationkey")).alias("c"), C.accession(F.concat(F.lit("GC(A)."), "n_nationkey", F.lit("-1"))).alias("a"), F.regexp_replace(F.concat(F.lit("chr"), "n_name"), "^chr", "").alias("s")),
     "SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 1 AND 16 THEN 'chr' || ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI'][n_nationkey] ELSE 'chromosome' || n_nationkey END AS c, 'GCA_' || n_nationkey || '_1' AS a, n_name AS s FROM nation")
both("c4_c5_c19_parsed", lambda t: t.part.select("p_partkey", F.trim(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("name"), C.number_in(F.col("p_brand")).alias("number"), F.substring("p_name", 1, 3).try_cast("int").alias("coerced")), "SELECT p_partkey, trim(p_name) AS name, try_cast(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS number, try_cast(substr(p_name, 1, 3) AS INT) AS coerced FROM part")
both("c8_c10_classes", lambda t: t.part.select("p_partkey", C.first_match(F.col("p_name"), [("ee", "long"), ("e", "e"), ("a", "a")], "other").alias("c")), "SELECT p_partkey, CASE WHEN contains(p_name, 'ee') THEN 'long' WHEN contains(p_name, 'e') THEN 'e' WHEN contains(p_name, 'a') THEN 'a' ELSE 'other' END AS c FROM part")
both("c9_c11_from_names", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("x_T"), "l_linenumber", F.lit("_ctx"), F.col("l_suppkey") % 10).alias("f")).select("l_orderkey", "l_linenumber", C.timepoint(F.col("f")).alias("time"), C.insertion_place(F.col("f")).alias("place")), "SELECT l_orderkey, l_linenumber, l_linenumber::INT AS time, (100 + 10 * (l_suppkey % 10))::INT AS place FROM lineitem")
both("c12_labels", lambda t: t.orders.groupBy(C.mapped(F.col("o_orderstatus"), {"F": "final", "O": "open"}).alias("label")).agg(F.count("*").alias("n")), "SELECT CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS label, count(*) AS n FROM orders GROUP BY 1")
both("c13_c20_scales", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.round(-F.log10(F.col("l_tax") + 0.001), 8).alias("minus_log10"), F.round(F.sqrt("l_quantity"), 8).alias("root"), F.round(F.abs(F.col("l_tax") - F.col("l_discount")), 8).alias("size")), "SELECT l_orderkey, l_linenumber, round(-log10(l_tax + 0.001), 8) AS minus_log10, round(sqrt(l_quantity), 8) AS root, round(abs(l_tax - l_discount), 8) AS size FROM lineitem")
both("c15_log_sed", lambda t: t.lineitem.groupBy("l_orderkey").agg(C.log_sed(F.collect_list("l_tax"), F.collect_list("l_discount")).alias("x")).select("l_orderkey", (F.round("x", 6) + 0.0).alias("x")), "SELECT l_orderkey, round(log2(sum(l_tax) + 1) - log2(sum(l_discount) + 1), 6) + 0.0 AS x FROM lineitem GROUP BY 1")
both("c16_shifted_log", lambda t: t.customer.crossJoin(F.broadcast(t.customer.agg(F.min("c_acctbal").alias("least")))).select("c_custkey", F.round(C.shifted_log(F.col("c_acctbal"), F.col("least")), 6).alias("x")), "SELECT c_custkey, round(ln(c_acctbal + CASE WHEN m <= 0 THEN 1 - m ELSE 0 END + 1e-8), 6) AS x FROM customer, (SELECT min(c_acctbal) AS m FROM customer)")
both("c21_split_lists", lambda t: t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ";").alias("s")).select("l_orderkey", F.explode(F.split("s", ";")).alias("item")).groupBy("item").agg(F.count("*").alias("n")), "SELECT l_returnflag AS item, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
both("c22_local_flag", lambda t: t.spans.join(t.supplier.select("s_suppkey", (F.col("s_suppkey") % 25).alias("chrom2")), F.col("line") == F.col("s_suppkey")).select("id", "line", C.is_local(F.col("start"), F.col("id"), F.col("chrom") == F.col("chrom2"), 8000).alias("local")), f"WITH {SPANS} SELECT id, line, abs(start - id) <= 8000 AND chrom = s_suppkey % 25 AS local FROM spans JOIN supplier ON line = s_suppkey")
both("c24_c26_windows", lambda t: t.spans.select("id", "line", C.window_start(F.col("end") - 100, F.col("start"), F.col("start") + 10, 50).alias("w"), *(c.alias(n) for c, n in zip(C.promoter(F.col("start"), F.col("end"), F.when(F.col("line") % 2 == 0, "+").otherwise("-"), F.lit(1000), 500), "ab"))), f"WITH {SPANS} SELECT id, line, CASE WHEN \"end\" - 100 <= start THEN floor((\"end\" - 100 + start) / 2)::BIGINT ELSE start + 10 - 50 END AS w, CASE WHEN line % 2 = 0 THEN greatest(start - 500, 0) ELSE \"end\" END AS a, CASE WHEN line % 2 = 0 THEN start ELSE least(\"end\" + 500, 1000) END AS b FROM spans")
both("c28_ratio", lambda t: t.lineitem.groupBy("l_suppkey").agg(F.round(C.percent(F.count_if(F.col("l_tax") == 0), F.count_if(F.col("l_discount") == 0)), 6).alias("pct")), "SELECT l_suppkey, round(CASE WHEN count(*) FILTER (l_discount = 0) > 0 THEN 100.0 * count(*) FILTER (l_tax = 0) / count(*) FILTER (l_discount = 0) ELSE 0 END, 6) AS pct FROM lineitem GROUP BY 1")
both("c25_both_conventions", lambda t: t.spans.select("id", "line", *(c.alias(n) for c, n in zip((*C.tss_window(F.col("start"), F.lit("+"), 450, 50), *C.tss_window(F.col("end"), F.lit("-"), 450, 50)), ("a", "b", "c", "d")))), f"WITH {SPANS} SELECT id, line, greatest(start - 450, 0) AS a, start + 50 AS b, greatest(\"end\" - 50, 0) AS c, \"end\" + 450 AS d FROM spans")

# sequences
S = "(SELECT doc_id, translate(text, 'etaoinshrdluETAOINSHRDLU', 'ACGTACGTACGTACGTACGTACGT') AS s, text FROM documents)"


def dna(t: Tables):
    return t.documents.select("doc_id", F.translate("text", "etaoinshrdluETAOINSHRDLU", "ACGT" * 6).alias("s"), "text")


both("q7_substituted", lambda t: dna(t).where("length(s) > 20").select("doc_id", C.substitute(F.col("s"), F.lit(10), F.lit("GATTACA"), F.lit(2)).alias("s")), f"SELECT doc_id, substr(s, 1, 10) || 'GATTACA' || substr(s, 13) AS s FROM {S} WHERE length(s) > 20")
both("q8_reference_check", lambda t: dna(t).where("length(s) > 20").select("doc_id", (F.substring("s", 11, 1) == "A").alias("ok")), f"SELECT doc_id, substr(s, 11, 1) = 'A' AS ok FROM {S} WHERE length(s) > 20")
both("q9_padded", lambda t: dna(t).select("doc_id", C.centred(F.col("s"), 100).alias("s")), f"SELECT doc_id, CASE WHEN length(s) >= 100 THEN substr(s, (length(s) - 100) // 2 + 1, 100) ELSE repeat('N', (100 - length(s)) // 2) || s || repeat('N', 100 - length(s) - (100 - length(s)) // 2) END AS s FROM {S}")
both("s8_fetch", lambda t: dna(t).select("doc_id", C.fetch(F.col("s"), F.lit(-5), F.lit(30)).alias("s")), f"SELECT doc_id, 'NNNNN' || substr(s, 1, 30) || repeat('N', greatest(30 - length(s), 0)) AS s FROM {S}")
both("q17_sizes", lambda t: dna(t).select("doc_id", F.length("s").alias("size")), f"SELECT doc_id, length(s) AS size FROM {S}")
both("q18_first_of_each", lambda t: W.first_per_key(t.documents.where("text IS NOT NULL").select(F.md5("text").alias("h"), "doc_id"), ["h"], ["doc_id"]).select("doc_id"), "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
both("q6_exon_mask", lambda t: t.hits.select("chrom", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("x")).distinct().groupBy("chrom").agg(F.count("*").alias("bits")), f"WITH {HITS} SELECT chrom, count(*) AS bits FROM ({COVERED} hits) GROUP BY 1")
both("q3_q12_round_trip", lambda t: dna(t).select("doc_id", C.from_one_hot(C.reverse_complement_matrix(C.one_hot(F.col("s")))).alias("s")), f"SELECT doc_id, reverse(translate(regexp_replace(upper(s), '[^ACGT]', 'T', 'g'), 'ACGT', 'TGCA')) AS s FROM {S}")
both("q11_q13_q15_matrix", lambda t: (lambda m: m.select("k", F.round(C.information(C.scaled(F.col("w"))), 6).alias("information"), F.round(F.aggregate(C.log_mean_ratio(C.scaled(F.col("w"))), F.lit(0.0), lambda a, x: a + x), 6).alias("log_ratio")))(t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.array(*(F.sum(c) + 1e-4 for c in ("l_tax", "l_discount", "l_quantity"))).alias("w"))),
     "WITH m AS (SELECT l_partkey AS k, sum(l_tax) + 1e-4 AS a, sum(l_discount) + 1e-4 AS b, sum(l_quantity) + 1e-4 AS c FROM lineitem GROUP BY 1), p AS (SELECT k, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM m) SELECT k, round(2 + a * log2(a + 1e-9) + b * log2(b + 1e-9) + c * log2(c + 1e-9), 6) AS information, round(a * ln(a * 3) + b * ln(b * 3) + c * ln(c * 3), 6) AS log_ratio FROM p")

# track arithmetic
both("r2_second_form", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.round(C.soft_clip_plain(F.col("l_quantity"), 32.0), 8).alias("soft")), "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 32 THEN 32 + sqrt(l_quantity - 32) ELSE l_quantity END, 8) AS soft FROM lineitem")
both("r3_median_baseline", lambda t: (lambda e: e.join(F.broadcast(W.percentiles(e.where("v IS NOT NULL").withColumn("all", F.lit(1)), ["all"], "v", {"base": 0.5}).drop("all"))).select("c_custkey", F.coalesce("v", "base").alias("v")))(t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("v"))), "SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, (SELECT quantile_cont(c_acctbal, 0.5) FROM customer WHERE c_acctbal >= 0)) AS v FROM customer")
both("r5_inverse", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.round(C.unscaled(F.col("l_quantity"), 0.5, 32.0, 0.75), 6).alias("v")), "SELECT l_orderkey, l_linenumber, round((CASE WHEN l_quantity / 0.5 > 32 THEN (l_quantity / 0.5 - 32) ** 2 + 32 ELSE l_quantity / 0.5 END) ** (1 / 0.75), 6) AS v FROM lineitem")
BY = "d AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS pos, l_discount AS r, l_tax AS a FROM lineitem)"
E_ = "CASE WHEN {x} > 0 AND {y} > 0 THEN {x} * ln({x} / {y}) WHEN {x} = 0 THEN 0 ELSE 'inf'::DOUBLE END"


def js(k: str, r: str, a: str) -> str:
    return f"{k}n AS (SELECT k, ({r} + q) / sum({r} + q) OVER (PARTITION BY k) AS x, ({a} + q) / sum({a} + q) OVER (PARTITION BY k) AS y FROM d JOIN (SELECT k, quantile_cont({r}, 0.25) AS q FROM d GROUP BY k) USING (k)), {k}j AS (SELECT k, round((sum({E_.format(x='x', y='y')}) + sum({E_.format(x='y', y='x')})) / 2, 6) AS {k} FROM {k}n GROUP BY k)"


both("r6_all_scores", lambda t: (lambda s: s.select("k", *(((F.round(c, 6) + 0.0).alias(c)) for c in s.columns if c != "k")))(K.variant_scores(t.lineitem.select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_discount").alias("r"), F.col("l_tax").alias("a")), ["k"], "r", "a", "pos")),
     f"WITH {BY}, {js('JS', 'r', 'a')}, {js('logJS', 'log2(r + 1)', 'log2(a + 1)')}, s AS (SELECT k, " + ", ".join(f"round(sum({f('a')} - {f('r')}), 6) + 0.0 AS \"{n}SUM\", round(sum(abs({f('a')} - {f('r')})), 6) + 0.0 AS \"{n}D1\", round(sqrt(sum(({f('a')} - {f('r')}) ** 2)), 6) + 0.0 AS \"{n}D2\"" for n, f in (("", lambda x: x), ("log", lambda x: f"log2({x} + 1)"), ("sqrt", lambda x: f"sqrt({x})"))) + ", round(arg_max(a - r, {'d': abs(a - r), 'p': -pos}), 6) + 0.0 AS \"SAX\" FROM d GROUP BY k) SELECT s.*, \"JS\" + 0.0 AS \"JS\", \"logJS\" + 0.0 AS \"logJS\" FROM s JOIN JSj USING (k) JOIN logJSj USING (k)")
both("r7_ism_scores", lambda t: t.lineitem.groupBy("l_suppkey").agg(F.sum("l_tax").alias("d"), (F.sum("l_quantity")).alias("p")).select("l_suppkey", *(F.round(c, 6).alias(n) for n, c in C.ism_scores(F.col("d"), F.col("p")).items())), "SELECT l_suppkey, round(ln(d + 1e-6), 6) AS plain, round(ln(d / p + 1e-6), 6) AS ratio, round(ln((d / p) / (1 - d / p) + 1e-6), 6) AS log_odds FROM (SELECT l_suppkey, sum(l_tax) AS d, sum(l_quantity) AS p FROM lineitem GROUP BY 1)")
both("r8_r11_projected", lambda t: t.lineitem.groupBy("l_partkey").agg((F.round(F.avg("l_tax"), 8)).alias("avg"), F.round(F.stddev_pop("l_tax"), 8).alias("sd"), F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_tax")).otherwise(0.0)), 8).alias("reference")), "SELECT l_partkey, round(avg(l_tax), 8) AS avg, round(stddev_pop(l_tax), 8) AS sd, round(sum(CASE WHEN l_returnflag = 'R' THEN l_tax ELSE 0 END), 8) AS reference FROM lineitem GROUP BY 1")
both("r13_localization", lambda t: (lambda m: m.join(W.percentiles(t.lineitem, ["l_suppkey"], "l_extendedprice", {"median": 0.5}), "l_suppkey").select("l_suppkey", F.round(F.col("peak") / F.col("median"), 6).alias("x")))(t.lineitem.groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("peak"))), "SELECT l_suppkey, round(max(l_extendedprice) / median(l_extendedprice), 6) AS x FROM lineitem GROUP BY 1")
both("r15_quantile_scale", lambda t: (lambda e: e.join(W.percentiles(e, ["user_id"], "value", {"q": 0.95}), "user_id").select("event_id", F.round(F.col("value") / F.col("q"), 6).alias("x")))(t.events.select("user_id", "event_id", "value")), "SELECT event_id, round(value / (SELECT quantile_cont(value, 0.95) FROM events f WHERE f.user_id = e.user_id), 6) AS x FROM events e")


@query("r12_r14_gene_slices", f"""WITH {HITS}, v AS (SELECT l_partkey // 16 AS bin, avg(l_tax) AS m FROM lineitem GROUP BY 1), b AS (SELECT DISTINCT id, unnest(range(start // 16, ("end" - 1) // 16 + 1)) AS bin FROM hits) SELECT id, round(sum(m), 6) AS total, count(*) AS bins FROM b JOIN v USING (bin) GROUP BY id""")
def gene_slices(t: Tables):
    mean = t.lineitem.groupBy(F.floor(F.col("l_partkey") / 16).alias("bin")).agg(F.avg("l_tax").alias("m"))
    return bins_over_exons(t).join(mean, "bin").groupBy("id").agg(F.round(F.sum("m"), 6).alias("total"), F.count("*").alias("bins"))


@query("q14_pwm_scan", f"""WITH w AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(range(0, greatest(length(s) - 3, 0))) AS i, unnest([substr(s, k, 4) FOR k IN range(1, greatest(length(s) - 2, 1))]) AS x FROM {S}) GROUP BY 1, 2),
  m AS (SELECT * FROM (VALUES ('one', 'TACG', '+'), ('one', 'CGTA', '-'), ('two', 'GGCA', '+'), ('two', 'TGCC', '-')) AS m(motif, m, o)),
  c AS (SELECT doc_id, i, motif, o, list_sum([CASE WHEN substr(x, k, 1) = substr(m, k, 1) THEN 1.5 WHEN substr(x, k, 1) IN ('A', 'C', 'G', 'T') THEN -2.0 ELSE 0.0 END FOR k IN range(1, 5)]) AS score FROM w, m)
  SELECT doc_id, motif, max(score)::DOUBLE AS score, arg_max(i, {{'s': score, 'o': o = '+', 'i': -i}}) AS place, arg_max(o, {{'s': score, 'o': o = '+', 'i': -i}}) AS strand FROM c GROUP BY 1, 2 HAVING max(score) >= 0.8 * 6.0""")
def pwm_scan(t: Tables):
    """Two matrices over the whole texts; they prefer TACG and GGCA."""
    motifs = {name: [[1.5 if b == x else -2.0 for b in "ACGT"] for x in best] for name, best in (("one", "TACG"), ("two", "GGCA"))}
    return K.pwm_scan(dna(t).select("doc_id", "s"), ["doc_id"], "s", motifs, 0.8)


@query("q16_dependency", """WITH d AS (SELECT l_suppkey % 5 AS g, l_linenumber AS pos, l_returnflag AS base, ln(avg(l_tax) + 0.01) AS v FROM lineitem GROUP BY 1, 2, 3) SELECT a.pos AS a, b.pos AS b, round(max(abs(a.v - b.v)), 6) AS effect FROM d a JOIN d b ON a.g = b.g AND a.base = b.base AND a.pos < b.pos GROUP BY 1, 2""")
def dependency(t: Tables):
    d = t.lineitem.groupBy((F.col("l_suppkey") % 5).alias("g"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("base")).agg(F.log(F.avg("l_tax") + 0.01).alias("v"))
    pairs = d.alias("x").join(d.alias("y"), ["g", "base"]).where("x.pos < y.pos")
    return pairs.groupBy(F.col("x.pos").alias("a"), F.col("y.pos").alias("b")).agg(F.round(F.max(F.abs(F.col("x.v") - F.col("y.v"))), 6).alias("effect"))


# tables, sinks and densities
both("d4_tss_table", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).otherwise(F.col("l_partkey") + F.col("l_linenumber")).alias("tss")), "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE l_partkey + l_linenumber END AS tss FROM lineitem")
both("k4_fasta_lines", lambda t: X.fasta_lines(t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("seq"))), "SELECT '>' || p_partkey || chr(10) || p_name AS value FROM part")
both("k8_statistics", lambda t: t.orders.agg(*(F.count_if(F.col("o_orderstatus") == k).alias(k) for k in "FOP")).select(F.to_json(F.struct("F", "O", "P")).alias("json")),
     """SELECT '{"F":' || count(*) FILTER (o_orderstatus = 'F') || ',"O":' || count(*) FILTER (o_orderstatus = 'O') || ',"P":' || count(*) FILTER (o_orderstatus = 'P') || '}' AS json FROM orders""")
both("s26_xml_scalar", lambda t: t.supplier.select("s_suppkey", X.xml_scalar(F.concat(F.lit("<r><a>x</a><LEVEL>"), F.col("s_nationkey").cast("string"), F.lit("</LEVEL></r>")), "LEVEL").alias("level"), X.xml_scalar(F.lit("<r><a>x</a></r>"), "LEVEL").alias("none")),
     "SELECT s_suppkey, s_nationkey::VARCHAR AS level, NULL::VARCHAR AS none FROM supplier")
both("s27_json_keys", lambda t: t.events.select("event_id", F.array_join(X.json_keys(F.to_json(F.struct("user_id", F.when(F.col("value") > 50, F.col("value")).alias("value")))), ",").alias("keys")),
     "SELECT event_id, CASE WHEN value > 50 THEN 'user_id,value' ELSE 'user_id' END AS keys FROM events")
both("m15_density", lambda t: M.density(t.customer.select(F.col("c_acctbal").cast("double").alias("v")), "v", [500.0 * i for i in range(20)]).select("x", F.round(F.col("density") * 1000, 6).alias("density")),
     "WITH v AS (SELECT c_acctbal::DOUBLE AS v FROM customer), o AS (SELECT count(*) AS n, stddev_samp(v) * count(*) ** -0.2 AS h FROM v) SELECT x, round(1000 * sum(exp(-0.5 * ((x - v) / h) ** 2) / (n * h * sqrt(2 * pi()))), 6) AS density FROM v, o, (SELECT 500.0::DOUBLE * unnest(range(20)) AS x) GROUP BY x")
