"""Personal data by weak supervision, with built-in functions only.

Patterns propose spans. Labelers (form, gazetteer, cues before and after, isolation, variety) vote for or against each,
or abstain. Expectation-maximisation estimates how reliable each labeler is from all spans of the corpus, without
labels; its posteriors train a logistic classifier over the spans' features, which decides on the proposed kinds. Spans
of the base kinds take part in both but always stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import cut
from .secrets import listed, running

#: Characters of context before and after a span; rounds of both estimations; how sure the classifier must be of a proposed kind.
BEFORE, AFTER, ROUNDS, STEPS, ACCEPT = 48, 24, 12, 40, 0.9
#: Fixed lists: common given names of the corpus's languages, and endings of domains.
NAMES = (
    "Alice Andrea Andreas Anna Anne Antonio Camille Carlos Carmen Charles Christian Claire Daniel David Elena Elizabeth Emily Emma Eva Fernando Francisco Frank George Hans "
    "Heinz Isabel James Javier Jean Jennifer Joachim John Jorge Jose Juan Julia Jürgen Karl Katharina Klaus Laura Linda Louis Lucia Luis Manuel Maria Marie Mark Martin Mary "
    "Michael Miguel Monika Nicolas Olivier Pablo Patricia Paul Pedro Peter Philippe Pierre Robert Sabine Sarah Sophie Stefan Susan Thomas Ursula William Wolfgang"
).split()
ENDINGS = "com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au ch at be pt br mx ar jp cn in ru pl se no dk fi".split()


@dataclass(frozen=True)
class Kind:
    """Spans of `pattern` (Java's syntax, leftmost and apart); those that fail `valid` are dropped.

    form: votes for a span that matches it, else against. listed, reserved: the gazetteer's votes for and against.
    cues, contrary: words before (or after) a span that speak for it or against it.
    """

    name: str
    pattern: str
    form: str
    cues: str
    listed: str = ""
    reserved: str = ""
    base: bool = False


WORDS = "A-Za-z0-9._%+-"
CONTRARY = r"(?i)\b(?:version|release|section|chapter|figure|fig|table|page|isbn|issn|order|invoice|lot|serial|part)\b[^\n]{0,12}\z"
#: The base comes first. Possessive repeats and the checks before a run keep a scan linear and don't change what matches.
KINDS = (
    Kind("email", rf"(?:(?<![{WORDS}])|\G)[{WORDS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}$",
         r"(?i)\b(?:e-?mail|mail|contact|write|reach|kontakt|courriel|correo)\b", rf"(?i)\.(?:{'|'.join(ENDINGS)})$", r"(?i)(?:no-?reply|postmaster|abuse)@|\.(?:invalid|test|localhost)$", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$", r"(?i)\b(?:ip|host|server|address|login|adresse|direcci[oó]n)\b", "", r"^(?:0|10|127|255)\.|^192\.168\.|^169\.254\.", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", r"^(?:4|5[1-5]|2[2-7]|3[47]|6)[0-9\x20-]+$", r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b", "", "", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"^\+[1-9][0-9]{0,2}[\x20().-][\x20().0-9-]+$", r"(?i)\b(?:phone|tel|call|mobile|fax|cell|telefon|téléphone|tel[eé]fono)\b", "", "", True),
    Kind("local_phone", r"(?<!\+[0-9]{1,3}[\x20.-]?)(?<![0-9A-Za-z.+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]", r"(?i)\b(?:phone|tel|call|mobile|fax|cell|telefon|téléphone|tel[eé]fono)\b"),
    Kind("national_id", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", r"(?i)\b(?:ssn|social security|national id|tax id)\b", "", r"^(?:123-45-6789|078-05-1120)$"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])", r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)[0-9]{2}[A-Z0-9]*[0-9]{6}", r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b"),
    Kind("hidden_email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z0-9-]{1,63}+){1,6}+", r"^[A-Za-z0-9]", r"(?i)\b(?:e-?mail|mail|contact|write|reach|kontakt|courriel|correo)\b", rf"(?i)(?:{'|'.join(ENDINGS)})$"),
    Kind("name", rf"(?=[A-Z])(?<![A-Za-z])(?:{'|'.join(NAMES)})(?:\x20[A-Z]\.)?\x20[A-Z][a-z]{{2,30}}+(?![A-Za-z])", r"^[^\x20]+\x20", r"(?i)\b(?:mr|mrs|ms|dr|prof|herr|frau|monsieur|madame|se[nñ]or|se[nñ]ora|name|contact|author|signed|dear|by)\b\.?[^\n]{0,8}\z"),
)
#: Labelers, each with a vote of 0 (abstains), 1 (for) or 2 (against), and features, each there or not.
LABELERS = ("form", "gazetteer", "cue", "contrary", "isolation", "variety")
FEATURES = ("form", "listed", "reserved", "cue", "contrary", "isolated", "varied", "cue_near", "long")
WIDTH = 1 + len(FEATURES) + len(KINDS) - 1
PART_255 = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def valid(kind: Kind, m: Column) -> Column:
    """Whether a match is a span at all."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind.name == "ip":
        return m.rlike(rf"^{PART_255}(?:\.{PART_255}){{3}}$")
    if kind.name == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind.name == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def judged(kind: Kind, order: int, s: Column) -> Column:
    """(a, order, b, kind, votes, features) of a span s(a, b, m, before, after): votes in base 3, features as bits."""
    m, before, after, never = s["m"], s["before"], s["after"], F.lit(False)
    form = m.rlike(kind.form)
    on_list = m.rlike(kind.listed) if kind.listed else never
    reserved = m.rlike(kind.reserved) if kind.reserved else never
    cue, near = before.rlike(kind.cues), F.substring(F.concat(F.lit(" " * 20), before), -20, 20).rlike(kind.cues)
    contrary = before.rlike(CONTRARY)
    isolated = ~before.rlike(r"[\w@]\z") & ~after.rlike(r"^[\w@]")
    varied = F.size(F.array_distinct(F.split(m, ""))) >= 5
    votes = (
        F.when(form, 1).otherwise(2), F.when(reserved, 2).when(on_list, 1).otherwise(0), F.when(cue, 1).otherwise(0), F.when(contrary, 2).otherwise(0),
        F.when(isolated, 1).otherwise(2), F.when(varied, 1).otherwise(2),
    )
    features = (form, on_list, reserved, cue, contrary, isolated, varied, near, F.length(m) > 12)
    packed = lambda items, base: sum((x.cast("int") * base**i for i, x in enumerate(items)), F.lit(0))
    return F.struct(s["a"].alias("a"), F.lit(order).alias("order"), s["b"].alias("b"), F.lit(kind.name).alias("kind"), packed(votes, 3).alias("votes"), packed(features, 2).alias("features"))


SPAN = "struct<a: int, order: int, b: int, kind: string, votes: int, features: int>"


def proposed(text: Column, order: int) -> Column:
    """The valid spans of a kind in text, judged."""
    kind = KINDS[order]
    gaps, hits = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    # a gap goes with the match after it and, as what follows, with the one before it
    parts = F.zip_with(F.transform(gaps, lambda g: F.struct(F.length(g).alias("n"), F.substring(F.concat(F.lit(" " * BEFORE), F.right(g, F.lit(BEFORE))), -BEFORE, BEFORE).alias("end"), F.left(g, F.lit(AFTER)).alias("start"))), hits, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    parts = F.zip_with(parts, F.slice(gaps, 2, 1 << 30), lambda p, g: F.struct(p["g"].alias("g"), p["m"].alias("m"), F.left(g, F.lit(AFTER)).alias("after")))
    parts = F.filter(parts, lambda p: p["m"].isNotNull())
    span = lambda at, p: F.struct((at + p["g"]["n"]).alias("a"), (at + p["g"]["n"] + F.length(p["m"])).alias("b"), p["m"].alias("m"), p["g"]["end"].alias("before"), p["after"].alias("after"))
    placed = running(parts, lambda a, v: a + v, lambda p: p["g"]["n"] + F.length(p["m"]), span, "struct<a: int, b: int, m: string, before: string, after: string>")
    return F.transform(F.filter(placed, lambda s: valid(kind, s["m"])), lambda s: judged(kind, order, s))


def propose(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(row, spans) for each row of docs(text, ...): the columns `keep`, and all proposed spans by start, then kind."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    found = [F.when(text.rlike(k.pattern), proposed(text, i)).otherwise(none) for i, k in enumerate(KINDS)]
    return docs.select(F.struct(*(docs[c] for c in keep)).alias("row"), F.array_sort(F.concat(*found)).alias("spans"))


def patterns(found: DataFrame) -> DataFrame:
    """(order, votes, features, n): how many spans have the same kind, votes and features; a table of bounded size."""
    spans = found.select(F.explode("spans").alias("s"))
    return cut(spans.groupBy("s.order", "s.votes", "s.features").agg(F.count("*").alias("n"))).coalesce(1)


def vote(j: int) -> Column:
    return F.expr(f"votes DIV {3**j} % 3")


@dataclass(frozen=True)
class Reliability:
    """prior: by kind. chance[class][labeler][vote]: how often a labeler votes so on spans that are no personal data (0) or are (1)."""

    prior: tuple[float, ...]
    chance: tuple

    def posterior(self) -> Column:
        """That a row of `patterns` is personal data."""
        pick = lambda values, at: F.element_at(F.array(*(F.lit(float(v)) for v in values)), at.cast("int") + 1)
        odds = pick([math.log(p / (1 - p)) for p in self.prior], F.col("order"))
        for j in range(len(LABELERS)):
            odds = odds + pick([math.log(self.chance[1][j][v] / self.chance[0][j][v]) for v in range(3)], vote(j))
        return 1 / (1 + F.exp(-odds))


def reliabilities(counts: DataFrame, rounds: int = ROUNDS) -> Reliability:
    """Expectation-maximisation over `patterns`: each round is one aggregation of a table of bounded size.

    It begins with labelers that are right four times in five; each count has one vote of that kind besides, which
    also keeps the classes from changing places.
    """
    right = {0: (1.0, 0.2, 0.8), 1: (1.0, 0.8, 0.2)}
    start = {c: tuple(v / sum(right[c]) for v in right[c]) for c in right}
    now = Reliability((0.5,) * len(KINDS), tuple(tuple(start[c] for _ in LABELERS) for c in (0, 1)))
    for _ in range(rounds):
        weighed = counts.withColumn("p", now.posterior())
        share = {0: F.col("n") * (1 - F.col("p")), 1: F.col("n") * F.col("p")}
        sums = [F.sum(F.when(vote(j) == v, share[c]).otherwise(0.0)).alias(f"v{c}_{j}_{v}") for c in (0, 1) for j in range(len(LABELERS)) for v in range(3)]
        sums += [F.sum(F.when(F.col("order") == k, share[c]).otherwise(0.0)).alias(f"k{c}_{k}") for c in (0, 1) for k in range(len(KINDS))]
        got = {k: v or 0.0 for k, v in weighed.agg(*sums).first().asDict().items()}
        chance = []
        for c in (0, 1):
            rows = [[got[f"v{c}_{j}_{v}"] + start[c][v] for v in range(3)] for j in range(len(LABELERS))]
            chance.append(tuple(tuple(round(x / sum(r), 9) for x in r) for r in rows))
        prior = tuple(round((got[f"k1_{k}"] + 1) / (got[f"k0_{k}"] + got[f"k1_{k}"] + 2), 9) for k in range(len(KINDS)))
        now = Reliability(prior, tuple(chance))
    return now


def inputs(order: Column, features: Column) -> list[Column]:
    """The classifier's inputs: 1, the features, and the kinds but for the first."""
    bits = [F.getbit(features, F.lit(i)).cast("double") for i in range(len(FEATURES))]
    return [F.lit(1.0), *bits, *((order == k).cast("double") for k in range(1, len(KINDS)))]


def solved(a: list[list[float]], b: list[float]) -> list[float]:
    """x with a x = b, for a small positive definite a."""
    n = len(b)
    rows = [[*a[i], b[i]] for i in range(n)]
    for i in range(n):
        best = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[best] = rows[best], rows[i]
        for r in range(i + 1, n):
            f = rows[r][i] / rows[i][i]
            rows[r] = [x - f * y for x, y in zip(rows[r], rows[i])]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (rows[i][n] - sum(rows[i][k] * x[k] for k in range(i + 1, n))) / rows[i][i]
    return x


def trained(counts: DataFrame, labels: Reliability, steps: int = STEPS) -> tuple[float, ...]:
    """Weights of a logistic classifier (ridge 1) of the posteriors, from sums over `patterns`.

    Each step divides the gradient by one fixed bound of the curvature, a quarter of the inputs' products, so it can't overshoot.
    """
    rows = counts.select("n", labels.posterior().alias("p"), *(x.alias(f"x{i}") for i, x in enumerate(inputs(F.col("order"), F.col("features")))))
    pairs = [(i, j) for i in range(WIDTH) for j in range(i, WIDTH)]
    products: Row = rows.agg(*(F.sum(F.col("n") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in pairs)).first()
    bound = [[0.0] * WIDTH for _ in range(WIDTH)]
    for i, j in pairs:
        bound[i][j] = bound[j][i] = (products[f"h{i}_{j}"] or 0.0) / 4 + (i == j)
    w = [0.0] * WIDTH
    for _ in range(steps):
        error = F.col("n") * (F.col("p") - 1 / (1 + F.exp(-sum((F.col(f"x{i}") * w[i] for i in range(1, WIDTH)), F.lit(w[0])))))
        slope = rows.agg(*(F.sum(error * F.col(f"x{i}")).alias(f"g{i}") for i in range(WIDTH))).first()
        step = solved(bound, [(slope[f"g{i}"] or 0.0) - w[i] for i in range(WIDTH)])
        w = [round(x + d, 9) for x, d in zip(w, step)]
    return tuple(w)


def find_personal(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(row, spans) for each row of docs(text, ...): the columns `keep`, and the spans (a, order, b, kind, votes, features).

    Spans are sorted by start, then kind; a and b in code points, b exclusive. Those of the base kinds are all there; of
    the proposed kinds, those which the classifier is sure of (ACCEPT). It is trained on all spans of docs, from counts
    of equal votes and features, so only a table of bounded size is gathered, and no text is shuffled. A null text is
    empty; rows are judged one by one, repeated ones alike; no other column is read; an empty table gives none. A text's
    cost grows with its length, not its square.
    """
    found = cut(propose(docs, keep))
    counts = patterns(found)
    w = trained(counts, reliabilities(counts))
    base = [k.name for k in KINDS if k.base]

    def sure(s: Column) -> Column:
        return sum((x * w[i] for i, x in enumerate(inputs(s["order"], s["features"]))), F.lit(0.0)) >= math.log(ACCEPT / (1 - ACCEPT))

    return found.select("row", F.filter("spans", lambda s: s["kind"].isin(base) | sure(s)).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> of the base, base_sha256 and spans, from find_personal."""
    base = [k.name for k in KINDS if k.base]
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_personal(docs).select("row.doc_id", *map(count, base), F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
