"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ready, tidy
from .graph import components

#: Hash tables, and buckets that a vector looks up in each table besides its own.
TABLES, PROBES = 14, 3
#: Vectors to a bucket to aim at; with more, one more polytope makes a table's buckets smaller.
PER_BUCKET = 2.0
SEED = 20240607


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows of x, whose width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2)
        h *= 2
    return x.reshape(n, d)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform: a pseudo-random rotation, up to scale."""
    signs = np.random.default_rng(seed).choice((-1.0, 1.0), (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def buckets(x: np.ndarray, table: int, polytopes: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bucket in a table, and PROBES more: the nearest other vertices of one polytope, least loss first."""
    n, d = x.shape
    names, losses, others = [], [], []
    for k in range(polytopes):
        r = rotated(x, SEED + 1000 * table + k)
        size = np.abs(r)
        top = np.argpartition(-size, min(PROBES, d - 1), axis=1)[:, : PROBES + 1]
        order = np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable")
        top = np.take_along_axis(top, order, 1)
        value = np.take_along_axis(r, top, 1)
        vertex = 2 * top + (value < 0)
        names.append(vertex[:, 0])
        for j in range(1, top.shape[1]):
            losses.append((np.abs(value[:, 0]) - np.abs(value[:, j])) / np.sqrt((r * r).sum(1)))
            others.append((k, vertex[:, j]))
    base = np.zeros(n, np.int64)
    scale = [(2 * d) ** (polytopes - 1 - k) for k in range(polytopes)]
    for v, s in zip(names, scale):
        base += v * s
    probes = np.stack([base + (v - names[k]) * scale[k] for k, v in others], 1)
    best = np.argsort(np.stack(losses, 1), axis=1, kind="stable")[:, :PROBES]
    return base, np.take_along_axis(probes, best, 1)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles, padded with zeros to a power of two."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    width = 1 << max(0, int(size.max(initial=1)) - 1).bit_length()
    out = np.zeros((len(size), max(2, width)))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _hashes(polytopes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                name = batch.column("rep").to_numpy()
                x = matrix(batch.column("v"))
                for t in range(TABLES):
                    own, probes = buckets(x, t, polytopes)
                    bucket = np.concatenate((own, probes.T.ravel()))
                    n = len(name)
                    role = np.repeat([True, False], [n, len(bucket) - n])
                    yield pa.record_batch([pa.array(np.full(len(bucket), t, np.int32)), pa.array(bucket), pa.array(role), pa.array(np.tile(name, len(bucket) // n))], names=["t", "bucket", "own", "rep"])

    return run


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node that the links (a, b) lead to."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


LINKED = "rep long, linked long, root long"


def _cosines(least: float):
    """Of pairs (a, b) with vectors and row counts: per batch and class in a link, the rows linked to it and a class that links lead to.

    So a group's links stay in the batch where they are found, and a row comes out for each class, not for each link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix(batch.column("va")), matrix(batch.column("vb"))
            if x.shape[1] != y.shape[1]:
                width = max(x.shape[1], y.shape[1])
                x, y = (np.pad(z, ((0, 0), (0, width - z.shape[1]))) for z in (x, y))
            keep = np.flatnonzero((x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))) >= least)
            a, b, na, nb = (batch.column(k).to_numpy()[keep] for k in ("a", "b", "na", "nb"))
            names, of = np.unique(np.concatenate((a, b)), return_inverse=True)
            linked = np.zeros(len(names), np.int64)
            np.add.at(linked, of, np.concatenate((nb, na)))
            yield pa.record_batch([pa.array(names), pa.array(linked), pa.array(names[roots(of[: len(a)], of[len(a) :], len(names))])], names=["rep", "linked", "root"])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """One row per row of vectors(vec_id, embedding): vec_id, n_links, component_id, kept.

    Rows link if the cosine of their vectors, in double precision, is `least` or more and a bucket of some table holds
    both (see the README for the measured recall); nothing below it links. n_links counts the other rows linked
    directly, component_id is the smallest vec_id that links reach, kept: it is the row's own. Vectors that are null,
    empty or zero, or hold a null or non-finite component, link with nothing. Vectors of different lengths are compared
    as if the shorter one ended in zeros. Rows of one vector are one class and are counted, not paired, so a vector that
    a third of all rows have costs one vector's work; repeated rows count as rows; a null vec_id is kept as null.
    Norms are scaled first, so very large or small vectors neither overflow nor vanish.
    """
    ready(vectors.sparkSession)
    v = F.col("embedding").cast("array<double>")
    ok = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(ok, v).alias("v"))
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = rows.withColumn("v", F.transform("v", lambda x: x / top + 0.0))  # and -0.0 as 0.0
    # two 64-bit hashes of the components name a vector's class
    code = F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("x"), F.xxhash64(F.lit(SEED), "v").alias("y")))
    rows = rows.select("vec_id", "v", code.alias("code"))
    classes = cut(rows.where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("v").alias("v")).withColumn("rep", F.coalesce("least", F.xxhash64("code"))))
    many = classes.count()
    width = classes.select(F.max(F.size("v"))).first()[0] or 2
    vertices = 2 << max(1, (width - 1).bit_length())
    polytopes = max(1, math.ceil(math.log(max(2.0, many / PER_BUCKET)) / math.log(vertices)))
    hashes = classes.select("rep", "v").mapInArrow(tidy(_hashes(polytopes)), "t int, bucket long, own boolean, rep long")
    own, probe = hashes.where("own").select("t", "bucket", F.col("rep").alias("x")), hashes.select("t", "bucket", F.col("rep").alias("y"))
    pairs = own.join(probe, ["t", "bucket"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    vector = classes.select("rep", "v", "n")
    pairs = pairs.join(vector.select(F.col("rep").alias("a"), F.col("v").alias("va"), F.col("n").alias("na")), "a").join(vector.select(F.col("rep").alias("b"), F.col("v").alias("vb"), F.col("n").alias("nb")), "b")
    links = cut(pairs.mapInArrow(tidy(_cosines(least)), LINKED))
    degree = links.groupBy("rep").agg(F.sum("linked").alias("linked"))
    joined = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("rep"), "component")
    named = classes.select("code", "rep", "n", "least").join(joined, "rep", "left").join(degree, "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("code", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "code").join(named, "code", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
