"""Shuffled windows and motif libraries."""

import tempfile
from collections import Counter
from random import Random

from lodestrand.operators import shuffles
from lodestrand.sources import text


def test_pairs_are_kept():
    rnd = Random(1)
    seen = set()
    for _ in range(300):
        s = "".join(rnd.choices("ACGT", k=rnd.randrange(40)))
        got = shuffles.pair_preserving(s, rnd)
        assert Counter(zip(got, got[1:])) == Counter(zip(s, s[1:])) and got[:1] == s[:1] and got[-1:] == s[-1:] and len(got) == len(s)
    for i in range(200):
        seen.add(shuffles.pair_preserving("ACAGATACCA", Random(i)))
    assert len(seen) > 20


def test_windows(spark):
    df = spark.createDataFrame([(1, "ACGTTGCANNACGGT"), (2, ""), (3, None), (4, "AC")], "id long, s string")
    for pairs in (True, False):
        rows = sorted(tuple(r) for r in shuffles.window_shuffles(df, "id", "s", 6, 2, pairs).collect())
        assert rows == sorted(tuple(r) for r in shuffles.window_shuffles(df.repartition(3), "id", "s", 6, 2, pairs).collect())
        assert [r[:3] for r in rows] == [(1, s, k) for s in (0, 6, 12) for k in (0, 1)] + [(4, 0, 0), (4, 0, 1)]
        for i, s, _, got in rows:
            want = {1: "ACGTTGCANNACGGT", 4: "AC"}[i][s : s + 6]
            assert Counter(got) == Counter(want) and (not pairs or Counter(zip(got, got[1:])) == Counter(zip(want, want[1:])))


def test_motif_library(spark):
    folder = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    with open(f"{folder}/a.meme", "w") as f:
        f.write("MEME version 4\n\nALPHABET= ACGT\n\nMOTIF one alt\nletter-probability matrix: alength= 4 w= 2 nsites= 20\n 0.1 0.2  0.3 0.4\n1 0 0 0\n\nURL http://x\n\nMOTIF none\n\nMOTIF two\n\nletter-probability matrix: alength= 4 w= 1\n0 0 1e-3 0\n9 9 9 9\n")
    got = {r["name"]: r["matrix"] for r in text.meme(spark, f"{folder}/a.meme").collect()}
    assert got == {"one": [[0.1, 0.2, 0.3, 0.4], [1, 0, 0, 0]], "two": [[0, 0, 0.001, 0]]}
    text.meme_records(spark.createDataFrame([("x", [[0.5, 0.5, 0.0, 0.0]] * 3), ("y", [[0.0, 0.0, 0.25, 0.75]])], "name string, matrix array<array<double>>").coalesce(1)).write.text(f"{folder}/b")
    assert {r["name"]: len(r["matrix"]) for r in text.meme(spark, f"{folder}/b").collect()} == {"x": 3, "y": 1}
