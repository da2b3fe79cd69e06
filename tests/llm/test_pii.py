"""Personal data: base spans against plain regular expressions, the rest against a plain re-statement of votes, EM and classifier."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DIGIT = re.compile("[0-9]")


def luhn(digits):
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


def good(kind, m):
    digits = [int(c) for c in DIGIT.findall(m)]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def base_spans(text):
    out = [(m.start(), o, m.end(), kind) for o, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if good(kind, m[0])]
    return sorted(out)


def brute(texts):
    """All spans of each text, by plain loops."""
    python = lambda p: re.compile(p.replace(r"(?<!\+[0-9]{1,3}[\x20.-]?)", ""), re.ASCII)
    found = []
    for text in texts:
        spans = []
        for o, k in enumerate(pii.KINDS):
            hits = list(re.finditer(BASE[k.name], text)) if k.base else list(python(k.pattern).finditer(text))
            if k.name == "local_phone":
                hits = [h for h in hits if not re.search(r"\+[0-9]{1,3}[\x20.-]?$", text[: h.start()])]
            for i, h in enumerate(hits):
                before = (" " * 48 + text[hits[i - 1].end() if i else 0 : h.start()])[-48:]
                after = text[h.end() : hits[i + 1].start() if i + 1 < len(hits) else None][:24]
                m = h[0]
                if k.base and not good(k.name, m):
                    continue
                has = lambda p, s: bool(p) and bool(re.search(p.replace(r"\z", r"\Z"), s, re.ASCII))
                form, on_list, reserved, cue, near, contrary = has(k.form, m), has(k.listed, m), has(k.reserved, m), has(k.cues, before), has(k.cues, before[-20:]), has(pii.CONTRARY, before)
                alone, varied = not re.search(r"[\w@]\Z", before, re.ASCII) and not re.search(r"^[\w@]", after, re.ASCII), len(set(m)) >= 5
                votes = (1 if form else 2, 2 if reserved else 1 if on_list else 0, int(cue), 2 * contrary, 1 if alone else 2, 1 if varied else 2)
                x = [1, form, on_list, reserved, cue, contrary, alone, varied, near, len(m) > 12] + [o == j for j in range(1, len(pii.KINDS))]
                spans.append((h.start(), o, h.end(), k.name, votes, np.array(x, float)))
        found.append(spans)
    flat = [s for spans in found for s in spans]
    right = {0: np.array([1, 0.2, 0.8]) / 2, 1: np.array([1, 0.8, 0.2]) / 2}
    prior, chance = [0.5] * len(pii.KINDS), {c: [right[c]] * 6 for c in (0, 1)}

    def posterior(s):
        odds = math.log(prior[s[1]] / (1 - prior[s[1]])) + sum(math.log(chance[1][j][v] / chance[0][j][v]) for j, v in enumerate(s[4]))
        return 1 / (1 + math.exp(-odds))

    for _ in range(pii.ROUNDS):
        p = [posterior(s) for s in flat]
        new = {c: [right[c].copy() for _ in range(6)] for c in (0, 1)}
        mass = [[1.0, 2.0] for _ in pii.KINDS]
        for q, s in zip(p, flat):
            for j, v in enumerate(s[4]):
                new[1][j][v] += q
                new[0][j][v] += 1 - q
            mass[s[1]][0] += q
            mass[s[1]][1] += 1
        chance = {c: [r / r.sum() for r in new[c]] for c in (0, 1)}
        prior = [a / b for a, b in mass]
    x, p = np.array([s[5] for s in flat]).reshape(-1, pii.WIDTH), np.array([posterior(s) for s in flat])
    w, bound = np.zeros(pii.WIDTH), x.T @ x / 4 + np.eye(pii.WIDTH)
    for _ in range(pii.STEPS):
        w += np.linalg.solve(bound, x.T @ (p - 1 / (1 + np.exp(-x @ w))) - w)
    limit = math.log(pii.ACCEPT / (1 - pii.ACCEPT))
    margin = min((abs(s[5] @ w - limit) for s in flat if s[1] >= 4), default=1)
    assert margin > 1e-6, "a tie would be decided by rounding"
    return [sorted(s[:4] for s in spans if s[1] < 4 or s[5] @ w >= limit) for spans in found], w


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    bits = ["a@b.c", "_d@e.f", "x.y", "@", ".", "..", "1.2.3.4", "001.2.255.256", "255.255.255.255", ".5", "4111 1111 1111 1111", "4111-1111-1111-1111-", "0" * 14, "0" * 20, "5" * 16, "+1 (407) 555-7710", "+", "++49 30", "-", " ", "\n", "é", "中", "😀", "٣", "w", "7", "12", "%", "a-b.c-d@e-f.g-h.", "(", ")"]
    fuzz = ["".join(rnd.choices(bits, k=rnd.randrange(1, 25))) for _ in range(500)]
    cards = ["".join(str(rnd.randrange(10)) for _ in range(rnd.randrange(13, 21))) for _ in range(300)]
    plain = [
        f"{rnd.choice(['call', 'phone', 'order', 'the', 'figure', 'tel'])} {rnd.choice(['415 555 0199', '(212) 555-0134', '000-00-0000', '219-09-9999', '078-05-1120', '666-12-1234'])} {rnd.choice(['and', 'x', ''])}"
        f" {rnd.choice(['mail', 'contact', 'section', ''])} {rnd.choice(['jo.doe [at] mail.org', 'ab (at) cd (dot) com', 'x@y.com', 'no-reply@z.test'])}, {rnd.choice(['Mr', 'Dear', 'saw'])} {rnd.choice(['Anna Smith', 'John Q. Public', 'Maria Lopez', 'Annabel Lee'])};"
        f" {rnd.choice(['IBAN', 'account', 'lot'])} {rnd.choice(['DE89370400440532013000', 'XX00AAAAAAAAAAA', 'GB29NWBK60161331926819'])} ssn 219-09-9999"
        for _ in range(120)
    ]
    long = ["a" * 60_000 + "@", "a@b" + ".c" * 40_000, "1" * 50_000, "1." * 30_000, "+1" + " 2" * 20_000, "1 " * 40_000, "call 415 555 0199 " * 3000, "a@b.c_d@e.f " * 3000, "@" * 50_000, "Anna " * 20_000]
    return [*fuzz, *cards, *plain, *long, None, "", " ", plain[0], plain[0]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(1), "row": F.lit("x"), "order": F.lit(2), "votes": F.lit(None).cast("int"), "n": F.lit(3)}).repartition(4)


def test_brute_force(docs, texts):
    want, w = brute([t or "" for t in texts])
    assert [[s for s in x if s[1] < 4] for x in want] == [base_spans(t or "") for t in texts]
    assert 0 < sum(s[1] >= 4 for x in want for s in x)
    made = Counter()
    for i, spans in enumerate(want):
        own = [s for s in spans if s[1] < 4]
        made[i if i % 50 else None, *(sum(s[3] == k for s in own) for k in BASE), hashlib.sha256(said(own).encode()).hexdigest(), said(spans)] += 1
    assert Counter(tuple(r) for r in pii.report(docs).collect()) == made
    counts = pii.patterns(pii.propose(docs))
    assert np.allclose(pii.trained(counts, pii.reliabilities(counts)), w, atol=1e-6)


def test_proposed_kinds_are_decided(docs):
    """Both verdicts occur, so the classifier has an effect."""
    asked = pii.propose(docs).select(F.explode("spans").alias("s")).where("s.order > 3").count()
    kept = pii.find_personal(docs).select(F.explode("spans").alias("s")).where("s.order > 3").count()
    assert 0 < kept < asked


def test_empty(docs):
    out = pii.report(docs.limit(0))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert out.count() == 0
