"""Mutants that are summed up where they are made."""

import random

from lodestrand.operators import tracks


def test_mutant_sums(spark, monkeypatch):
    rnd = random.Random(4)
    texts = [(i, "".join(rnd.choice("ACGTacNé\0 ÿ\U0001f600" if i % 3 else "ACGTn\0") for _ in range(rnd.randrange(150)))) for i in range(60)]
    texts += [(90, "xyz"), (91, ""), (92, None), (93, "AAAA"), (94, "T"), (0, "A" * 70), (95, "nÿ\U0001f600"), (96, "Aé" * 33)]
    monkeypatch.setattr(tracks, "MUTATED", 7)
    want = {}
    for i, s in texts:
        for w in range(0, len(s or ""), 32):
            own = s[w : w + 32]
            for k, c in enumerate(own):
                for b in "ACGT":
                    if c in "ACGT" and b != c:
                        n, places, first, last = want.get(i, (0, 0, None, None))
                        m = own[:k] + b + own[k + 1 :]
                        want[i] = (n + 1, places + k, m if first is None else min(first, m), m if last is None else max(last, m))
    got = tracks.mutant_sums(spark.createDataFrame(texts, "doc_id long, s string"), ["doc_id"], "s")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row for a window or a mutant
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want
