"""Logistic regression by Newton steps over grouped sums, all folds of a cross-validation in one pass a step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .clusters import kept
from .metrics import roc_pr
from .windows import ranked_rows


def stratified_folds(df: DataFrame, label: str, order: str, folds: int = 5) -> DataFrame:
    """df with fold: each label's rows, in a unique order, are cut in runs, so that every fold has its part of them.

    The rows in order of label are dealt out over the folds in turn; so many of a label a fold gets, as a run of them.
    """
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    before, fold = 0, F.lit(None).cast("int")
    for value in sorted(x for x in sizes if x is not None):
        share = [len(range((k - before) % folds, sizes[value], folds)) for k in range(folds)]
        ends = np.cumsum(share).tolist()
        own = F.lit(folds - 1)
        for k in reversed(range(folds - 1)):
            own = F.when(F.col("rank") <= ends[k], k).otherwise(own)
        fold = F.when(F.col(label) == value, own).otherwise(fold)
        before += sizes[value]
    return ranked_rows(df, [label], order).withColumn("fold", fold).drop("rank")


def logistic_folds(df: DataFrame, features: list[str], label: str = "label", fold: str = "fold", penalty: float = 1.0, steps: int = 50) -> dict[int, list[float]]:
    """For each fold the weights (intercept first) of the logistic model of the rows outside it, with half `penalty` times their squares.

    Each Newton step is one pass over df: rows count for the folds they are outside of, and a fold's gradient and curvature
    are sums by fold, so a task sends a row for each of their numbers. It ends when no weight moves by 1e-10. The intercept is penalised too.
    """
    folds = sorted(r[0] for r in df.select(fold).where(F.col(fold).isNotNull()).distinct().collect())
    width = len(features) + 1
    ship(df.sparkSession)
    rows = df.na.drop(subset=[*features, label, fold]).select(F.col(label).cast("double").alias("y"), F.col(fold).cast("long").alias("own"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features, 1)))
    w = {f: np.zeros(width) for f in folds}
    for _ in range(steps if folds else 0):
        parts = rows.mapInArrow(_sums(w, width), "f long, i int, v double").groupBy("f", "i").agg(F.sum("v").alias("v"))
        sums: dict = {f: np.zeros(width + width * width) for f in folds}
        met = set()
        for r in parts.collect():  # folds times the weights, squared
            sums[r["f"]][r["i"]] = r["v"]
            met.add(r["f"])
        moved = 0.0
        for f in sorted(met):
            g, h = sums[f][:width], sums[f][width:].reshape(width, width)
            step = np.linalg.solve(h + penalty * np.eye(width), g - penalty * w[f])
            w[f] = w[f] + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-10:
            break
    return {f: v.tolist() for f, v in w.items()}


def _sums(w: dict[int, np.ndarray], width: int):
    """(f, i, v): each fold's gradient and curvature over this task's rows outside it, a batch of rows by arrays at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            y, own = batch.column("y").to_numpy(), batch.column("own").to_numpy()
            x = np.column_stack([np.ones(len(y)), *(batch.column(f"x{i}").to_numpy() for i in range(1, width))])
            for f, weights in w.items():
                out = own != f
                if not out.any():
                    continue
                with np.errstate(over="ignore"):
                    p = 1 / (1 + np.exp(-(x @ weights)))
                g, v = np.where(out, y - p, 0.0) @ x, np.where(out, p * (1 - p), 0.0)
                sums[f] = sums.get(f, 0) + np.concatenate([g, ((x * v[:, None]).T @ x).ravel()])
        for f, v in sums.items():
            yield pa.record_batch([pa.array([f] * len(v), pa.int64()), pa.array(range(len(v)), pa.int32()), pa.array(v)], names=["f", "i", "v"])

    return run


def cross_validated_auc(df: DataFrame, features: list[str], label: str, order: str, folds: int = 5) -> DataFrame:
    """(fold, n, auroc) of each fold's rows by the model of the others (M16); folds are stratified, see above.

    Folds are dealt once and written to the shared folder: the steps would order the whole table again each.
    """
    named = kept(stratified_folds(df.na.drop(subset=[*features, label]), label, order, folds).select(*features, label, "fold"))
    w = logistic_folds(named, features, label)
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    score = F.lit(None).cast("double")
    for f, own in w.items():
        score = F.when(F.col("fold") == f, sum((c * v for c, v in zip(x, own)), F.lit(0.0))).otherwise(score)
    return roc_pr(named.select("fold", F.col(label).alias("label"), score.alias("score")), ["fold"], 2).select("fold", "n", "auroc")
