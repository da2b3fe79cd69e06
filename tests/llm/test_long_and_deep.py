"""Long texts, deep pages and hot groups: linear cost, and the same results as slow versions."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import embed_dedup, html_text, quality, secrets, token_files

TAGS = "p div table tr td th li ul ol dl dt dd caption tbody thead option select object span b br html template ruby rt rp form h1 optgroup menu".split()


class SlowOpen(html_text.Open):
    """The open elements as a plain list that each tag walks."""

    def last(self, names):
        return max((i for i, n in enumerate(self.stack) if i and n.name in names), default=0)

    def close(self, names, limits):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name in names:
                del self.stack[i:]
                return True
            if self.stack[i].name in limits:
                return False
        return False


def test_trees_of_random_markup(monkeypatch):
    rnd = random.Random(1)
    pages = ["".join(rnd.choice(["<%s>", "</%s>", "<%s>x", " y</%s>", "<%s a=\"1>2\" b='q'>"]) % rnd.choice(TAGS) for _ in range(rnd.randrange(1, 60))) for _ in range(1500)]
    fast = [html_text.render(p) for p in pages]
    monkeypatch.setattr(html_text, "Open", SlowOpen)
    assert fast == [html_text.render(p) for p in pages]


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<div>x<p>y<li>z" * 20_000, "<b>" * 50_000 + "</i>" * 50_000, "<a b='" * 20_000, "<ul><li>a" * 2_000])
def test_deep_pages_end_soon(page):
    began = time.time()
    html_text.render(page)
    assert time.time() - began < 15


def test_pages_through_spark(spark):
    rows = [(1, "u", "<p>a<p>b"), (2, "u", None), (3, None, ""), (1, "u", "<p>a<p>b"), (4, "v", "<div>" * 20_000 + "deep"), (None, "w", "<p hidden>x"), (5, "x", "word " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "row": F.lit(1)})
    got = html_text.extract_text(df).select("row.page_id", "row.url", "text").collect()
    want = [(p, u, None if h is None else html_text.render(h)) for p, u, h in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert [t for p, _, t in want if p in (1, 3)] == ["a\n\nb", "", "a\n\nb"]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_long_texts_with_many_runs(spark):
    rnd = random.Random(2)
    prose = " ".join(rnd.choice(["bad", "face", "cafe", "deed", "a", "b1"]) for _ in range(200_000))
    half = len(prose) // 2
    texts = [prose[:half] + " " + "0af" * 12 + " " + prose[half:], " ".join(f"token=abcdefgh{i}" for i in range(20_000)), "AKIA" * 9 + " password: short " * 5_000, "AKIAABCDEFGHIJKL" + "ü" * 300 + "AKIAABCDEFGHIJK"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in secrets.report(df).collect()}
    assert time.time() - began < 90
    for i, t in enumerate(texts):
        found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(secrets.RULES[0].pattern, t) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert got[i]["spans"] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_rules_of_ones_own(spark):
    """A new rule is looked up in the index by its own trigrams."""
    own = secrets.Rule("vault", r"hvs\.[A-Za-z0-9_-]{12,}")
    texts = ["a hvs.abcdefghijklmnop b", "hvs. short", "HVS.abcdefghijkl", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["a"], s["b"], s["kind"]) for s in r["__spans"]] for r in secrets.find_secrets(df, (*secrets.RULES, own)).collect()}
    assert got == {0: [(2, 22, "vault")], 1: [], 2: [], 3: []}
    index = secrets.postings(secrets._keyed(df), ["hvs", "vs.", "zzz"])
    assert sorted((r["__doc"], r["tri"]) for r in index.collect()) == [(i, t) for i in range(3) for t in ("hvs", "vs.")]


def test_candidates_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(1, "token=abcdefgh1"), (2, "none"), (None, "AKIAABCDEFGHIJKLMN"), (1, "token=abcdefgh1")], "doc_id long, text string")
    told = sorted(map(str, secrets.report(df).collect()))
    monkeypatch.setattr(secrets, "TOLD_DOCS", 0)
    assert sorted(map(str, secrets.report(df).collect())) == told


def test_lines_are_counted_by_documents(spark):
    """Copies under many ids are many documents; a repeated row is one; hosts are apart, and a null host is one."""
    line = "one line of boilerplate"
    copy = line + "\n" + " ".join(f"c{k}" for k in range(60))
    rows = [(i, copy, "h") for i in range(30)] + [(100, "a\n" + " ".join(f"d{k}" for k in range(60)), "h")] * 40
    rows += [(200 + i, "\n".join((line, *(" ".join(f"e{i}x{j}x{k}" for k in range(6)) for j in range(10)))), None) for i in range(19)]
    out = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    left = {r["doc_id"]: (r["n_words"], r["left_words"]) for r in out}
    assert left[0] == (64, 0) and left[100] == (61, 61) and left[200] == (64, 64) and len(out) == len(rows)


def test_reader_takes_a_task_for_each_shard(spark):
    import public_tokenizers

    df = spark.range(0, 400).selectExpr("id AS doc_id", "concat('some words ', id) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few words would be one shard
    shards = token_files.write_token_files(df, public_tokenizers.path("word_bpe_49k.json"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert token_files.read_token_files(shards).rdd.getNumPartitions() == shards.count() > 1


def test_links_of_a_hot_group(spark):
    """Exact links, counts and components of a dense group, a chain, copies, and noise."""
    rnd = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base = unit(rnd.standard_normal(32))
    dense = unit(base + 0.035 * rnd.standard_normal((150, 32)))
    v = np.concatenate((dense, unit(rnd.standard_normal((200, 32))), np.repeat(dense[:1], 40, 0)))
    cosine = v @ v.T
    link = (cosine >= 0.95) & ~np.eye(len(v), dtype=bool)
    assert 0.3 < link[:150, :150].mean() < 1
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")).collect()}
    counts = np.array([got[i]["n_links"] for i in range(len(v))])
    assert (counts <= link.sum(1)).all() and counts.sum() >= 0.97 * link.sum()
    assert {got[i]["component_id"] for i in range(150)} == {0} and got[360]["component_id"] == 0
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_roots():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        n = int(rnd.integers(2, 40))
        a, b = rnd.integers(0, n, (2, int(rnd.integers(1, 40))))
        want = np.arange(n)
        for _ in range(n):
            for x, y in zip(a, b):
                want[x] = want[y] = min(want[x], want[y])
        assert (embed_dedup.roots(a, b, n) == want).all()
