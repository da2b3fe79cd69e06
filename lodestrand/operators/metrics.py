"""Evaluation aggregates as grouped expressions: one shuffle by group, ties handled before any running sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import counted, running_sums


def _steps(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group and distinct score, from the highest: counts of positives and all, and their running sums."""
    at = df.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("label").isNotNull()).groupBy(*by, "score").agg(F.sum("label").cast("bigint").alias("p"), F.count("*").alias("n"))
    at = running_sums(at.withColumn("q", F.col("n") - F.col("p")), by, "score", {"tp": "p", "fp": "q"}, descending=True)
    return at.select(*by, "score", "p", "q", (F.col("tp") + F.col("p")).alias("tp"), (F.col("fp") + F.col("q")).alias("fp"))


def roc_pr(df: DataFrame, by: list[str], least: int = 10) -> DataFrame:
    """n, auroc and average precision of df(by, label 0/1, score) per group with `least` rows and both labels (M1, M2, M5, F8).

    AUROC is the trapezoid over distinct scores, average precision the sum of recall steps times precision.
    """
    s = _steps(df, by)
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2))
    out = s.groupBy(*by).agg(F.sum(F.col("p") + F.col("q")).alias("n"), F.sum("p").alias("np"), F.sum("q").alias("nq"), area.alias("area"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    out = out.where((F.col("n") >= least) & (F.col("np") > 0) & (F.col("nq") > 0))
    return out.select(*by, "n", (F.col("area") / (F.col("np") * F.col("nq"))).alias("auroc"), (F.col("ap") / F.col("np")).alias("auprc"))


def roc_curve(df: DataFrame, by: list[str]) -> DataFrame:
    s = _steps(df, by).withColumn("__key", F.struct(*by))
    most = s.groupBy("__key").agg(F.max("tp").alias("__p"), F.max("fp").alias("__q"))
    return s.join(most, "__key").select(*by, "score", (F.col("tp") / F.col("__p")).alias("tpr"), (F.col("fp") / F.col("__q")).alias("fpr"))


def guarded_corr(x: str, y: str) -> Column:
    """Pearson, null where a side is constant or there are fewer than two rows."""
    return F.when((F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) > 1) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson of the average ranks, per group (M8). Rows are counted by value on each side; the ranks of those short tables
    are scanned in blocks of values and meet the rows, counted by both values, once."""
    pairs = df.na.drop(subset=[x, y]).groupBy(*by, x, y).agg(F.count("*").alias("n"))

    def ranks(v: str, name: str) -> DataFrame:
        at = running_sums(pairs.groupBy(*by, v).agg(F.sum("n").alias("n")), by, v, {"before": "n"})
        return at.select(F.struct(*by).alias("__key"), v, (F.col("before") + (F.col("n") + 1) / 2).alias(name))

    ranked = pairs.withColumn("__key", F.struct(*by)).join(ranks(x, "__rx"), ["__key", x]).join(ranks(y, "__ry"), ["__key", y])
    a, b, n = F.col("__rx"), F.col("__ry"), F.col("n")
    # about the ranks' mean, which is (rows + 1) / 2 in each group
    mean = pairs.groupBy(F.struct(*by).alias("__key")).agg(((F.sum("n") + 1) / 2).alias("__m"))
    centred = ranked.join(mean, "__key")
    da, db = a - F.col("__m"), b - F.col("__m")
    out = centred.groupBy(*by).agg(F.sum(n * da * db).alias("ab"), F.sum(n * da * da).alias("aa"), F.sum(n * db * db).alias("bb"))
    return out.select(*by, F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("spearman"))


def normal_tail(z: Column) -> Column:
    """The part of the standard normal above z, to 1e-7. The five coefficients of the classic rational approximation."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = poly * F.exp(-z * z / 2) / 2.5066282746310002
    return F.when(z >= 0, upper).otherwise(1 - upper)


def mann_whitney(df: DataFrame, by: list[str]) -> DataFrame:
    """U of label 1 over label 0, the normal score z with tie correction, and p for greater, less and two-sided, per group of df(by, label, score).

    Rows are counted by (group, score) first; the rank of a score is what lies below it, from a running sum over distinct
    scores. p is the normal approximation with continuity correction.
    """
    at = df.na.drop(subset=["label", "score"]).groupBy(*by, "score").agg(F.sum("label").alias("p"), F.count("*").alias("t"))
    agg = running_sums(at, by, "score", {"below": "t"}).withColumn("r", F.col("below") + (F.col("t") + 1) / 2).groupBy(*by).agg(F.sum("p").alias("n1"), F.sum("t").alias("n"), F.sum(F.col("p") * F.col("r")).alias("r1"), F.sum(F.col("t") * (F.col("t") * F.col("t") - 1)).alias("ties"))
    n1, n, n0 = F.col("n1"), F.col("n"), F.col("n") - F.col("n1")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    score = lambda x: F.try_divide(x - 0.5, sd)
    mid = n1 * n0 / 2
    greater, less = normal_tail(score(u - mid)), normal_tail(score(mid - u))
    two = F.least(2 * normal_tail(score(F.abs(u - mid))), F.lit(1.0))
    return agg.where((n1 > 0) & (n0 > 0) & (n > 1)).select(*by, u.alias("u"), F.try_divide(u - mid, sd).alias("z"), greater.alias("p_greater"), less.alias("p_less"), two.alias("p_two_sided"))


def kolmogorov_smirnov(df: DataFrame, by: list[str]) -> DataFrame:
    """The largest distance between the two labels' step functions, and its asymptotic p."""
    at = df.na.drop(subset=["label", "score"]).groupBy(*by, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    run = running_sums(at, by, "score", {"pb": "p", "qb": "q"}).withColumn("__key", F.struct(*by))
    run = run.join(at.groupBy(F.struct(*by).alias("__key")).agg(F.sum("p").alias("n1"), F.sum("q").alias("n0")), "__key")
    d = run.select(*by, "n1", "n0", F.abs((F.col("pb") + F.col("p")) / F.col("n1") - (F.col("qb") + F.col("q")) / F.col("n0")).alias("d"))
    d = d.groupBy(*by).agg(F.max("d").alias("ks"), F.max("n1").alias("n1"), F.max("n0").alias("n0"))
    x = F.col("ks") * F.sqrt(F.col("n1") * F.col("n0") / (F.col("n1") + F.col("n0")))
    series = sum((F.exp(-2.0 * k * k * x * x) * (1 if k % 2 else -1) for k in range(1, 21)), F.lit(0.0))
    return d.select(*by, "ks", F.greatest(F.least(2 * series, F.lit(1.0)), F.lit(0.0)).alias("p"))


def cohens_d(df: DataFrame, by: list[str]) -> DataFrame:
    """(mean of label 1 - mean of label 0) / pooled sample deviation."""
    one, zero = (F.when(F.col("label") == k, F.col("score")) for k in (1, 0))
    agg = df.groupBy(*by).agg(*(f(x).alias(f"{n}{k}") for k, x in ((1, one), (0, zero)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return agg.where("n1 > 1 AND n0 > 1").select(*by, F.try_divide(F.col("m1") - F.col("m0"), pooled).alias("cohens_d"))


def explained_variance(y: str, fit: str) -> Column:
    return 1 - F.try_divide(F.var_pop(F.col(y) - F.col(fit)), F.var_pop(y))


def interpolated(curve: DataFrame, by: list[str], grid: DataFrame) -> DataFrame:
    """Linear interpolation of curve(by, x, y) at grid(g) (M3, M6): flat beyond the ends; the grid is a small fixed table.

    Curve and grid go through one ordered window, so no group meets all grid points pair by pair.
    """
    groups = curve.select(*by).distinct().crossJoin(F.broadcast(grid))  # groups x a fixed grid is the result's own size
    both = curve.select(*by, "x", "y", F.lit(0).alias("__k")).unionByName(groups.select(*by, F.col("g").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(1).alias("__k")))
    point = F.when(F.col("__k") == 0, F.struct("x", "y"))
    up, down = (Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for order in (("x", "__k", "y"), (F.desc("x"), F.desc("__k"), F.desc("y"))))
    a, b = F.last(point, True).over(up), F.last(point, True).over(down)
    r = both.select(*by, "x", "__k", a.alias("a"), b.alias("b")).where("__k = 1")
    part = F.try_divide(F.col("x") - F.col("a.x"), F.col("b.x") - F.col("a.x"))
    y = F.when(F.col("a").isNull(), F.col("b.y")).when(F.col("b").isNull() | (F.col("x") == F.col("a.x")), F.col("a.y")).otherwise(F.col("a.y") + part * (F.col("b.y") - F.col("a.y")))
    return r.select(*by, F.col("x").alias("g"), y.alias("y"))


def verdict(df: DataFrame) -> DataFrame:
    """df(mode, reported, reproduced, rtol, atol) with delta and verdict (M24): approx, ge, gt, le, or MISSING."""
    a, b = F.col("reproduced"), F.col("reported")
    ok = F.when(F.col("mode") == "ge", a >= b).when(F.col("mode") == "gt", a > b).when(F.col("mode") == "le", a <= b).otherwise(F.abs(a - b) <= F.col("atol") + F.col("rtol") * F.abs(b))
    return df.withColumns({"delta": a - b, "verdict": F.when(a.isNull(), "MISSING").when(ok, "PASS").otherwise("FAIL")})


def curve_band(curves: DataFrame, member: str, least: int = 2) -> DataFrame:
    """(g, mean, sem, low, high) over members at each grid point, of `least` members or more; the band within 0 and 1 (M4)."""
    agg = curves.groupBy("g").agg(F.avg("y").alias("mean"), (F.stddev_samp("y") / F.sqrt(F.count("y"))).alias("sem"), F.count_distinct(member).alias("n")).where(F.col("n") >= least)
    low, high = F.greatest(F.col("mean") - F.col("sem"), F.lit(0.0)), F.least(F.col("mean") + F.col("sem"), F.lit(1.0))
    return agg.select("g", "mean", "sem", low.alias("low"), high.alias("high"))


def region_scores(a: Column, n_a: Column, b: Column, n_b: Column) -> dict[str, Column]:
    """Precision, recall, F1 and Jaccard from the regions of each side that overlap the other, counted apart (A17); Jaccard takes the first side's."""
    precision, recall = F.try_divide(a, n_a), F.try_divide(b, n_b)
    return {"precision": precision, "recall": recall, "f1": F.try_divide(2 * precision * recall, precision + recall), "jaccard": F.try_divide(a, n_a + n_b - a)}


def density(df: DataFrame, value: str, grid: list[float]) -> DataFrame:
    """(x, density) of a Gaussian kernel density at each x of grid, with Scott's bandwidth.

    The grid is fixed and short; each row meets it in place, and sums are partial before the shuffle.
    """
    one = df.where(F.col(value).isNotNull()).agg(F.count("*").alias("n"), (F.stddev_samp(value) * F.pow(F.count("*"), F.lit(-0.2))).alias("h"))  # one row
    rows = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(one)).withColumn("x", F.explode(F.array(*map(F.lit, grid))))
    kernel = F.exp(-F.pow((F.col("x") - F.col(value)) / F.col("h"), 2) / 2) / (F.col("n") * F.col("h") * F.sqrt(F.lit(2) * F.pi()))
    return rows.groupBy("x").agg(F.sum(kernel).alias("density"))
