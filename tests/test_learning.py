"""Clusters and classifiers against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import clusters, learn
from lodestrand.operators.windows import hash_order


@pytest.fixture(scope="module")
def points():
    rnd = np.random.default_rng(3)
    centres = rnd.normal(0, 6, (6, 4))
    return [(i, int(i % 7 == 0) + 2 * (i % 6 > 2), [float(v) for v in centres[i % 6] + rnd.normal(0, 1, 4)]) for i in range(200)]


def frame(spark, points):
    return spark.createDataFrame(points, "id long, label int, x array<double>").repartition(4)


@pytest.mark.parametrize("method", ["ward", "average"])
def test_linkage(spark, points, method):
    x = {i: np.array(v) for i, _, v in points}
    size, d = {i: 1 for i in x}, {(i, j): float(((x[i] - x[j]) ** 2).sum()) ** (1 if method == "ward" else 0.5) for i in x for j in x if i < j}
    want = []
    while d:
        (a, b), h = min(d.items(), key=lambda kv: (kv[1], kv[0]))
        want.append((a, b, math.sqrt(h) if method == "ward" else h, size[a] + size[b]))
        for k in size:
            if k not in (a, b):
                ak, bk = d[min(a, k), max(a, k)], d[min(b, k), max(b, k)]
                na, nb, nk = size[a], size[b], size[k]
                d[min(a, k), max(a, k)] = ((na + nk) * ak + (nb + nk) * bk - nk * h) / (na + nb + nk) if method == "ward" else (na * ak + nb * bk) / (na + nb)
                del d[min(b, k), max(b, k)]
        del d[a, b]
        size[a] += size.pop(b)
    got = clusters.linkage(frame(spark, points), method).collect()
    key = lambda r: (round(r[2], 6), r[0], r[1])
    assert [(r[0], r[1], r[3]) for r in sorted(got, key=key)] == [(r[0], r[1], r[3]) for r in sorted(want, key=key)]
    assert np.allclose(sorted(r["height"] for r in got), sorted(r[2] for r in want), rtol=1e-9)
    assert max(r["round"] for r in got) < 40


def test_linkage_of_ties_and_few(spark):
    same = [(i, 0, [float(i // 2), 0.0]) for i in range(6)] + [(None, 0, [1.0, 1.0]), (9, 0, None)]
    got = clusters.linkage(frame(spark, same), "average").collect()
    assert sorted((r["a"], r["b"], r["height"]) for r in got)[:1] == [(0, 1, 0.0)] and len(got) == 5
    assert clusters.linkage(frame(spark, same[:1])).count() == 0


def test_kmeans(spark, points):
    df = frame(spark, [*points, (900, 1, None), (901, 1, [1.0, None, 2.0, 3.0])])
    order = [r["id"] for r in df.where("id < 900").orderBy(hash_order("id")).collect()]
    x = np.array([v for _, _, v in points])
    c = np.array([points[i][2] for i in order[:6]])
    for _ in range(100):
        at = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[at == k].mean(axis=0) if (at == k).any() else c[k] for k in range(6)])
        if np.abs(new - c).max() < 1e-12:
            break
        c = new
    assert np.allclose(clusters.kmeans_centres(df, 6), c, atol=1e-9)
    got = {r["id"]: r for r in clusters.kmeans(df, 6).collect()}
    assert [got[i]["cluster"] for i in range(200)] == at.tolist() and got[900]["cluster"] is None and got[901]["cluster"] is None
    assert clusters.kmeans(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("rows", [1024, 30])
def test_silhouettes(spark, points, rows, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", rows)
    own = [*points, (500, 9, [0.0] * 4)]
    x, label = np.array([v for _, _, v in own]), np.array([k for _, k, _ in own])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {}
    for i, (name, k, _) in enumerate(own):
        n = (label == k).sum()
        a = d[i, label == k].sum() / (n - 1) if n > 1 else 0
        b = min(d[i, label == m].mean() for m in set(label.tolist()) - {k})
        want[name] = (b - a) / max(a, b) if n > 1 else 0.0
    got = {r["id"]: r["silhouette"] for r in clusters.silhouettes(frame(spark, [*own, (None, 1, [0.0] * 4), (7000, None, [0.0] * 4)])).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=1e-12)
    assert clusters.silhouettes(frame(spark, [(1, 1, [0.0]), (2, 1, [1.0])])).where("silhouette IS NULL").count() == 2


def test_logistic(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        a, b = rnd.gauss(0, 1), rnd.gauss(0, 2)
        rows.append((i, int(rnd.random() < 1 / (1 + math.exp(-(0.5 + a - 0.7 * b)))), a, b))
    df = spark.createDataFrame(rows + [(900, 1, None, 1.0), (901, None, 1.0, 1.0)], "id long, label int, a double, b double").repartition(4)
    folds = learn.stratified_folds(df.na.drop(), "label", "id")
    fold = {r["id"]: r["fold"] for r in folds.collect()}
    zeros, ones = ([r for r in rows if r[1] == k] for k in (0, 1))
    y = [0] * len(zeros) + [1] * len(ones)
    want = {}
    for k, own in enumerate((zeros, ones)):
        counts = [sum(v == k for v in y[i::5]) for i in range(5)]
        want |= {r[0]: f for r, f in zip(own, [f for f, n in enumerate(counts) for _ in range(n)])}
    assert fold == want
    got = learn.logistic_folds(folds, ["a", "b"])
    for f in range(5):
        x = np.array([[1, r[2], r[3]] for r in rows if fold[r[0]] != f])
        t, w = np.array([r[1] for r in rows if fold[r[0]] != f]), np.zeros(3)
        for _ in range(20000):
            w += 0.005 * (x.T @ (t - 1 / (1 + np.exp(-x @ w))) - w)
        assert np.allclose(got[f], w, atol=1e-6)
    auc = {r["fold"]: r["auroc"] for r in learn.cross_validated_auc(df, ["a", "b"], "label", "id").collect()}
    for f in range(5):
        s = [(r[1], got[f] @ np.array([1, r[2], r[3]])) for r in rows if fold[r[0]] == f]
        pos, neg = [v for k, v in s if k], [v for k, v in s if not k]
        assert abs(auc[f] - sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)) < 1e-9
