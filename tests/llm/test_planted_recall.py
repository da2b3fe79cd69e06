"""Recall of links on planted pairs just over 0.95, at several numbers of polytopes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import embed_dedup


def planted(n, cosine=0.951, width=64):
    rnd = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rnd.standard_normal((n, width)))
    away = rnd.standard_normal((n, width))
    return x, cosine * x + np.sqrt(1 - cosine**2) * unit(away - (away * x).sum(1, keepdims=True) * x)


@pytest.mark.parametrize("polytopes", [1, 2, 3, 4, 5])
def test_recall_of_buckets(polytopes):
    x, y = planted(2000)
    met = np.zeros(len(x), bool)
    for t in range(embed_dedup.TABLES):
        (a, pa), (b, pb) = (embed_dedup.buckets(v, t, polytopes) for v in (x, y))
        met |= (a == b) | (pa == b[:, None]).any(1) | (pb == a[:, None]).any(1)
    print(f"recall {met.mean():.4f} at {polytopes} polytopes")
    assert met.mean() >= 0.97


def test_planted_links_are_found(spark):
    """1,000 vectors make two polytopes."""
    x, y = planted(500)
    v = np.concatenate((x, y))
    want = int(((v @ v.T) >= 0.95).sum()) - len(v)
    assert want >= 1000
    got = embed_dedup.near_vectors(spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")).agg(F.sum("n_links")).first()[0]
    print(f"links {got} of {want}")
    assert want * 0.97 <= got <= want
