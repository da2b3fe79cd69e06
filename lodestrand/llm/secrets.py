"""Secret scans through a trigram inverted index, with built-in functions only."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, few_rows

#: The parser moved in Python 3.11.
try:
    from re import _constants as C
    from re import _parser as P
except ImportError:
    import sre_constants as C
    import sre_parse as P

NULL_ID = -(1 << 63)
#: Trigrams asked for each string that a match must hold, and strings to tell apart before they count as any.
ASKED, SPREAD = 4, 32
#: Candidates that are broadcast to the scan of the texts (about 60 bytes each); more are joined by a shuffle.
TOLD_DOCS = 200_000
#: Items of an array that one running total goes over; arrays of many are dealt with in blocks of so many.
STRETCH = 128


@dataclass(frozen=True)
class Rule:
    """Matches of pattern are spans of `kind` if `group` of them has `least` characters or more.

    scan: a pattern with the same spans that has `least` in it, in Java's syntax, so that short matches are never made.
    rest: what a span takes in after `pattern`, in Java's syntax; it matches the empty string too.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    scan: str = ""
    rest: str = ""


#: A line's end, as it is or written as \\n in a string.
END_OF_LINE = r"(?:[\x20\t\r]*+\n[\x20\t]*+|(?:\\r)?\\n)"
#: After a key's first line: all up to its last line, if no other marker is before; else headers and base64 lines, as far as they go.
KEY_BODY = (
    r"(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{END_OF_LINE}++[A-Za-z-]++:[^\n]*+)*+(?:{END_OF_LINE}++[A-Za-z0-9+/]{{32,}}+={{0,2}})++(?:{END_OF_LINE}[A-Za-z0-9+/]++={{0,2}}(?=\s|\z))?|)"
)
#: Fixed formats. The first three are the base; in assign, the letters of the name are in either case.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True, r"AKIA[A-Z0-9]{12,}+"),
    Rule("hex", r"[0-9a-f]+", 0, 32, True, r"(?<![0-9a-f])[0-9a-f]{32,}+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", rest=KEY_BODY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)


def mandatory(pattern: str) -> list[list[str]]:
    """Strings that any match holds, lower case: one of each list. Lists with a string under three characters say nothing."""
    said: list[list[str]] = []

    def close(run: set[str]) -> set[str]:
        if run != {""}:
            said.append(sorted(run))
        return {""}

    def exact(node) -> set[str] | None:
        """All strings that a node can match, if they are few."""
        out = {""}
        for op, value in node:
            if op is C.LITERAL:
                some = {chr(value).lower()}
            elif op is C.SUBPATTERN:
                some = exact(value[3])
            elif op is C.BRANCH:
                each = [exact(x) for x in value[1]]
                some = None if None in each else set().union(*each)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[1] != C.MAXREPEAT and value[1] <= 8:
                one = exact(value[2])
                some = None if one is None else {"".join([x] * n) for x in one for n in range(value[0], value[1] + 1)} if len(one) == 1 else None
            elif op is C.IN and all(k is C.LITERAL for k, _ in value) and len(value) <= 6:
                some = {chr(v).lower() for _, v in value}
            else:
                some = None
            if some is None or len(out) * len(some) > SPREAD:
                return None
            out = {a + b for a in out for b in some}
        return out

    def walk(node, run: set[str]) -> set[str]:
        for item in node:
            some = exact([item])
            if some is not None and len(run) * len(some) <= SPREAD:
                run = {a + b for a in run for b in some}
            elif item[0] is C.SUBPATTERN:
                run = walk(item[1][3], run)
            else:
                run = close(run)
        return run

    close(walk(P.parse(pattern), {""}))
    return [strings for strings in said if all(len(x) >= 3 for x in strings)]


def trigrams(text: str) -> list[str]:
    """Up to ASKED trigrams of text, spread over it."""
    all_ = list(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2)))
    return all_ if len(all_) <= ASKED else [all_[round(i * (len(all_) - 1) / (ASKED - 1))] for i in range(ASKED)]


def query(rule: Rule) -> list[list[list[str]]]:
    """The rule's Boolean trigram query: each list must have a string whose trigrams are all there. Empty: scan fully."""
    return [[trigrams(x) for x in strings] for strings in mandatory(rule.pattern)]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "__twin": F.xxhash64(text)})


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(tri, __doc, __twin): the inverted index of _keyed docs over the wanted trigrams (lower case), made in one pass over each text."""
    any_of = "|".join(re.escape(t) for t in sorted(wanted))
    first = "".join(sorted({re.escape(t[0]) for t in wanted}))
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    # a look-ahead takes no characters, so trigrams that overlap are all found
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?=[{first}])(?=({any_of}))"), F.lit(1)))
    return docs.select(F.explode(found).alias("tri"), "__doc", "__twin")


def lookup(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(__doc, __twin, __rules): the documents that a rule with mandatory trigrams may match, by its Boolean query over the postings."""
    queries = {r.kind: q for r in rules if (q := query(r))}
    asked = [(t, k, i, j, len(string)) for k, q in queries.items() for i, clause in enumerate(q) for j, string in enumerate(clause) for t in string]
    spark = index.sparkSession
    terms = few_rows(spark, asked, "tri string, kind string, clause int, string int, needs int")
    clauses = few_rows(spark, [(k, len(q)) for k, q in queries.items()], "kind string, clauses int")
    # each term's list is looked up by its trigram; lists of one string are intersected, those of one clause united, clauses intersected
    lists = index.join(F.broadcast(terms), "tri")  # the rules' terms: a table of fixed size
    strings = lists.groupBy("__doc", "__twin", "kind", "clause", "string", "needs").agg(F.count_distinct("tri").alias("n")).where("n = needs")
    rules_met = strings.groupBy("__doc", "__twin", "kind").agg(F.count_distinct("clause").alias("n")).join(F.broadcast(clauses), "kind").where("n = clauses")
    return rules_met.groupBy("__doc", "__twin").agg(F.collect_set("kind").alias("__rules"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(__doc, __twin, __rules) of _keyed docs, see `lookup`."""
    wanted = sorted({t for r in rules for clause in query(r) for string in clause for t in string})
    return lookup(postings(docs, wanted), rules)


def running(items: Column, add: Callable[[Column, Column], Column], value: Callable[[Column], Column], make: Callable[[Column, Column], Column], kind: str) -> Column:
    """make(total before x, x) for each x of an array, total: value(x) of those before put together by add (from 0).

    Blocks of STRETCH items have their totals first, so an array of n costs n * STRETCH + (n / STRETCH) ** 2 steps, not n ** 2.
    """
    zero, none = F.lit(0), F.expr(f"CAST(array() AS array<{kind}>)")

    def step(a: Column, e: Column) -> Column:
        return F.struct(add(a["at"], value(e)).alias("at"), F.concat(a["all"], F.array(make(a["at"], e))).alias("all"))

    def totals(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda x: F.aggregate(x, zero, lambda a, e: add(a, value(e))))
        before = F.slice(F.aggregate(ends, F.array(zero), lambda a, e: F.concat(a, F.array(add(F.element_at(a, -1), e)))), F.lit(1), F.size(blocks))
        return F.flatten(F.zip_with(blocks, before, lambda x, b: F.aggregate(x, F.struct(b.alias("at"), none.alias("all")), step, lambda a: a["all"])))

    def blocks(all_: Column) -> Column:
        return F.transform(F.sequence(zero, F.floor(F.greatest(F.size(all_) - 1, zero) / STRETCH).cast("int")), lambda b: F.slice(all_, b * STRETCH + 1, STRETCH))

    # as a lambda's argument an array is made once, however often the lambda refers to it
    once = lambda x, f: F.get(F.transform(F.array(x), f), zero)
    return once(items, lambda x: once(blocks(x), totals))


SPAN = "struct<a: int, order: int, b: int, kind: string>"


def spans(text: Column, rule: Rule) -> Column:
    """The rule's matches in text, leftmost and apart, as (a, order, b, kind): from a to b in code points."""
    pattern = F.lit((rule.scan or rule.pattern) + rule.rest)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    each = F.zip_with(F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("g"), F.length(h).alias("h"))), kept, lambda x, k: F.struct(x["g"].alias("g"), x["h"].alias("h"), F.length(k).alias("k")))
    each = F.filter(each, lambda x: x["h"].isNotNull())
    order = [r.kind for r in RULES].index(rule.kind) if rule in RULES else len(RULES)
    span = lambda at, x: F.struct((at + x["g"]).alias("a"), F.lit(order).alias("order"), (at + x["g"] + x["h"]).alias("b"), F.lit(rule.kind).alias("kind"), x["k"].alias("k"))
    found = running(each, lambda a, v: a + v, lambda x: x["g"] + x["h"], span, "struct<a: int, order: int, b: int, kind: string, k: int>")
    found = F.filter(found, lambda x: x["k"] >= rule.least) if rule.least else found
    return F.transform(found, lambda x: F.struct(x["a"].alias("a"), x["order"].alias("order"), x["b"].alias("b"), x["kind"].alias("kind")))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs(doc_id, text, ...) with __spans: an array of (a, order, b, kind), by start, then kind as listed; a, b in code points.

    Rules of mandatory trigrams are tried on the index's candidates only, the others (hex) on every text. A null text is
    empty. Rows of one doc_id and text share candidates and are rows of their own; rows with a null doc_id are looked up
    by a stand-in for it; all columns of docs stay, and only names that begin with two underscores are added; empty
    tables give none. A text's cost grows with its length, not its square, however many matches it has (see `running`).
    """
    keyed = _keyed(docs)
    some = cut(candidates(keyed, rules))
    # what is told has a checked size; more goes by a shuffle of the texts
    found = keyed.join(F.broadcast(some) if some.count() <= TOLD_DOCS else some, ["__doc", "__twin"], "left")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    parts = []
    for r in rules:
        here = F.when(text.rlike(r.scan or r.pattern), spans(text, r)).otherwise(none)
        parts.append(F.when(F.array_contains("__rules", r.kind), here).otherwise(none) if query(r) else here)
    return found.withColumn("__spans", F.array_sort(F.concat(*parts))).drop("__rules", "__doc", "__twin")


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> of the base, base_sha256 and spans, from find_secrets."""
    base = [r.kind for r in RULES if r.base]
    own = F.filter("__spans", lambda s: s["kind"].isin(base))
    count = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs).select("doc_id", *map(count, base), F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("__spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with each secret (overlapping spans as one) replaced by mark; n_chars, if there, follows."""
    found = find_secrets(docs)
    # before each span that begins a secret: what lies between it and the furthest end so far. None goes before others that overlap it.
    far = running(F.col("__spans"), lambda a, v: F.greatest(a, v), lambda x: x["b"], lambda at, x: F.struct(at.alias("far"), x["a"].alias("a"), x["b"].alias("b")), "struct<far: int, a: int, b: int>")
    pieces = F.transform(F.filter("__far", lambda x, i: (i == 0) | (x["a"] >= x["far"])), lambda x: F.substring("text", x["far"] + 1, x["a"] - x["far"]))
    last = F.substring("text", F.array_max(F.transform("__far", lambda x: x["b"])) + 1, F.lit(2**31 - 1))
    found = found.withColumn("__far", far)
    text = F.concat(F.array_join(pieces, mark), F.lit(mark), last)
    found = found.withColumn("text", F.when(F.size("__spans") > 0, text).otherwise(F.col("text")))
    return found.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))

