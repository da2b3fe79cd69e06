"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, FEW, blocks, cut, gathered, mix, packed, ready, shingle_sets, text_bytes, tidy, U, unpacked
from .graph import components

#: Most frequent shingles that are told to every task, as 8-byte hashes (4 MB). They only set the order in which a
#: document's shingles are tried, so a shingle that isn't told costs time and never a link.
MOST_FREQUENT = 500_000
#: A shingle is worth telling from so many sightings, counting in each task those seen LOCAL times or more.
FREQUENT, LOCAL = 48, 4
#: Ratio of the sizes in one band; two sets that link differ by 1 / threshold at most, so by few bands.
BAND = 1.25
#: Classes in a bucket from which it is hot, as one with a frequent shingle is: stars join what they can of it first.
HOT_ROWS = 64
#: Classes in a bucket up to which all its pairs are counted; from there on rows carry bitmaps, and unlike pairs end in their tile.
COLD_ROWS = 4
#: Star rounds at most, and the part of a round's pairs that must link for one more.
ROUNDS, WORTH = 8, 0.25
#: Ids of texts that are broadcast to the scan that fetches them (16 bytes each); more are joined by a shuffle.
TOLD_IDS = 250_000
#: Tasks that the rows of one frequent shingle are dealt out to, and pairs of a class that one task verifies.
SALTS, GROUP = 64, 512
#: Rows of one tile; a larger bucket is dealt out to tiles by pairs of blocks of this size.
TILE_ROWS = 4096
#: Pairs that a tile holds before they go on.
HELD_PAIRS = 500_000
#: Words of bitmaps that are compared at once.
PAIR_WORDS = 1 << 18


def bitmap(s: np.ndarray) -> np.ndarray:
    """Each member flips a bit, of a power of two of bits, at least twice as many as members and 64.

    Members that two sets share cancel out between their bitmaps, so each bit in which they differ stands for a member that one of them lacks.
    """
    bits = max(64, 1 << int(2 * len(s) - 1).bit_length())
    at = np.bincount((mix(s) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(at.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(b: np.ndarray, words: int) -> np.ndarray:
    while len(b) > words:
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return b


def bound(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> int:
    """The intersection is no larger: the sets differ by a member for each bit in which their bitmaps do, at least."""
    words = min(len(a), len(b))
    differ = int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())
    return min((n_a + n_b - differ) // 2, n_a, n_b)


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = mix(np.array([np.add.reduce(mix(s ^ U(0xA0761D6478BD642F))), np.bitwise_xor.reduce(s), len(s)], np.uint64))
    return int(mix(total[:1] + mix(total[1:2] + total[2:3])).view(np.int64)[0])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        data, at = text_bytes(batch.column("text"))
        for i, j in blocks(at, BLOCK_BYTES // 2):
            yield batch, i, shingle_sets(data, at[i : j + 1])


PROFILE = "kind int, id long, n long, cls long, bits binary"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a document with its set's size, class and bitmap. Kind 1: a shingle that this task saw LOCAL times, and how often (n)."""
    waiting, held = [], 0
    names = ["kind", "id", "n", "cls", "bits"]

    def frequent(parts: list[np.ndarray]) -> pa.RecordBatch:
        s = np.sort(np.concatenate(parts))
        edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
        n = np.diff(edge)
        often = n >= LOCAL
        value, n = s[edge[:-1]][often], n[often].astype(np.int64)
        return pa.record_batch([pa.array(np.ones(len(n), np.int32)), pa.array(value.view(np.int64)), pa.array(n), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary())], names=names)

    for batch, i, sets in _sets(batches):
        ids = batch.column("doc_id").slice(i, len(sets)).cast(pa.int64())
        yield pa.record_batch([pa.array(np.zeros(len(sets), np.int32)), ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary())], names=names)
        waiting += sets
        held += sum(map(len, sets))
        if held > 4_000_000:  # 32 MB; counts start anew
            yield frequent(waiting)
            waiting, held = [], 0
    if held:
        yield frequent(waiting)


def prefix(s: np.ndarray, frequent: np.ndarray, threshold: Fraction) -> np.ndarray:
    """The first |s| - ceil(t |s|) + 1 members in one order for all sets, shingles that are known to be frequent last.

    Two sets with a Jaccard similarity of t or more have a member of both prefixes in common.
    """
    keep = len(s) - -(-threshold.numerator * len(s) // threshold.denominator) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        hit = frequent[at] == s
        if hit.any():
            s = np.concatenate((s[~hit], s[hit]))
    return s[:keep]


ENTRIES = "tok long, cls long, n int, told boolean"


def _entries(frequent, threshold: Fraction):
    """The prefix of each class that a task meets; told: the shingle is a frequent one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(frequent.value, np.uint64)
        seen: set[int] = set()  # classes that this task has dealt with, of the last million
        for _, _, sets in _sets(batches):
            tokens, names, lengths, sizes = [], [], [], []
            for s in sets:
                if len(s) and (c := class_of(s)) not in seen:
                    seen.add(c)
                    p = prefix(s, often, threshold)
                    tokens.append(p)
                    names.append(c)
                    lengths.append(len(p))
                    sizes.append(len(s))
            if len(seen) > 1_000_000:
                seen.clear()
            if tokens:
                tok = np.concatenate(tokens)
                told = often[np.minimum(np.searchsorted(often, tok), len(often) - 1)] == tok if len(often) else np.zeros(len(tok), bool)
                yield pa.record_batch([pa.array(tok.view(np.int64)), pa.array(np.repeat(np.array(names, np.int64), lengths)), pa.array(np.repeat(np.array(sizes, np.int32), lengths)), pa.array(told)], names=["tok", "cls", "n", "told"])

    return run


def _bounded(threshold: Fraction):
    """Of pairs (a, n_a, bits_a, b, n_b, bits_b), those whose bitmaps allow a link, and how large they let it be (as a similarity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            parts = [_words(batch.column(k)) for k in ("bits_a", "bits_b")]
            flat = np.concatenate([p[0] for p in parts])
            start = np.concatenate((parts[0][1], parts[1][1] + len(parts[0][0])))
            size = np.concatenate([p[2] for p in parts])
            n = np.concatenate([batch.column(k).to_numpy() for k in ("n_a", "n_b")])
            i = np.arange(rows)
            most = _most(flat, start, size, n, i, i + rows)
            keep = pa.array(_allowed(threshold, most, n[:rows], n[rows:]))
            like = pa.array(most / (n[:rows] + n[rows:] - most))
            yield pa.record_batch([*(batch.column(k).filter(keep) for k in ("a", "b")), like.filter(keep)], names=["a", "b", "like"])

    return run


def _exact(threshold: Fraction):
    """Of groups in order of (a, part): rows of a's text (b is null) and of texts of classes b, the pairs that link.

    Sorted arrays are intersected. Texts whose class isn't the one that is looked for (another row of the same doc_id) go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, None
        for batch in batches:
            texts = unpacked(batch.column("z"))
            a, part, b = (batch.column(k).to_pylist() for k in ("a", "part", "b"))
            data, at = text_bytes(texts)
            out = []
            for i, j in blocks(at, BLOCK_BYTES // 2):
                for k, s in enumerate(shingle_sets(data, at[i : j + 1]), i):
                    if (a[k], part[k]) != group:
                        group, own = (a[k], part[k]), None
                    if not len(s) or class_of(s) != (a[k] if b[k] is None else b[k]):
                        continue
                    if b[k] is None:
                        own = s
                    elif own is not None:
                        p, q = sorted((own, s), key=len)
                        o = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                        if threshold.denominator * o >= threshold.numerator * (len(p) + len(q) - o):
                            out.append((a[k], b[k]))
            yield pa.record_batch([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit words of a column of bitmaps, and each one's start and size in words."""
    column = column.cast(pa.large_binary())
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] >> 3
    flat = np.frombuffer(raw, np.uint64, raw.size >> 3) if raw is not None else np.zeros(0, np.uint64)
    return flat, at[:-1], np.diff(at)


def _folds(flat: np.ndarray, start: np.ndarray, size: np.ndarray, words: int) -> np.ndarray:
    """One row for each bitmap flat[start : start + size], folded to `words` words."""
    out = np.zeros((len(start), words), np.uint64)
    for k in range(0, int(size.max(initial=0)), words):
        on = np.flatnonzero(size > k)
        out[on] ^= flat[start[on, None] + k + np.arange(words)]
    return out


def _most(flat: np.ndarray, start: np.ndarray, size: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What the bitmaps of the pairs (i, j) let their intersections be at most, see `bound`."""
    most = np.zeros(len(i), np.int64)
    words = np.minimum(size[i], size[j])
    for w in np.unique(words):
        same = np.flatnonzero(words == w)
        step = max(1, PAIR_WORDS // int(w))
        for at in (same[k : k + step] for k in range(0, len(same), step)):
            p, q = i[at], j[at]
            x, y = _folds(flat, start[p], size[p], w), _folds(flat, start[q], size[q], w)
            most[at] = np.minimum((n[p] + n[q] - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)) // 2, np.minimum(n[p], n[q]))
    return most


def _allowed(threshold: Fraction, most: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return most * (threshold.denominator + threshold.numerator) >= threshold.numerator * (n_a + n_b)


class _Lists:
    """Sorted lists of tokens, one for each row."""

    def __init__(self, lists: pa.ListArray):
        self.flat, self.size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        known, self.rank = np.unique(self.flat, return_inverse=True)
        self.width = len(known) + 1
        self.key = np.repeat(np.arange(len(lists)), self.size) * self.width + self.rank  # ascends

    def first_met(self, tok: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs (i, j) that meet in tok[i], those for which it is the least token that both lists hold, and how many both hold."""
        first, shared = np.zeros(len(i), bool), np.zeros(len(i), np.int64)
        step = max(1, PAIR_WORDS // max(1, int(self.size.max(initial=0))))
        for k in range(0, len(i), step):
            p, q = i[k : k + step], j[k : k + step]
            n = self.size[p]
            pair = np.repeat(np.arange(len(p)), n)
            at = np.repeat(self.start[p] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            wanted = q[pair] * self.width + self.rank[at]
            hit = self.key[np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)] == wanted
            shared[k : k + step] = np.bincount(pair[hit], minlength=len(p))
            first[k : k + step] = np.bincount(pair[hit & (self.flat[at] < tok[p][pair])], minlength=len(p)) == 0
        return first, shared


def _tiles(threshold: Fraction, signed: bool, listed: bool = False):
    """Of rows in order of tile (tok, k, p, q) and n, the pairs of different components in a tile, and in how many tiles they met.

    A tile has the rows at home in band k and guests from above; a pair needs one at home. All tiles of a batch go
    together: step d compares each row with the d-th after it, as long as that is in its tile and near in size. signed:
    rows carry bitmaps, and pairs whose bitmaps don't allow a link go here. listed: rows carry all tokens of their class
    that have tiles, so that a pair comes out of the tile of its least one only, with the number of all.
    """

    def counted(a: list[np.ndarray], b: list[np.ndarray], met: list[np.ndarray]) -> pa.RecordBatch:
        x, y, met = map(np.concatenate, (a, b, met))
        low, high = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        edge = np.flatnonzero(_moved(low, high))
        met = np.add.reduceat(met[order], edge) if len(edge) else met
        return pa.record_batch([pa.array(low[edge]), pa.array(high[edge]), pa.array(met)], names=["a", "b", "met"])

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        tok, k, p, q, name, n, comp, part, home = (table.column(c).to_numpy() for c in ("tok", "k", "p", "q", "cls", "n", "comp", "part", "home"))
        flat, start, size = _words(table.column("bits").combine_chunks()) if signed else (None,) * 3
        lists = _Lists(table.column("toks").combine_chunks()) if listed else None
        edge = np.append(np.flatnonzero(_moved(tok, k, p, q)), len(tok))
        stop = np.repeat(edge[1:], np.diff(edge))
        split = p != q  # a tile of two blocks has the pairs between them only
        found: list[tuple[np.ndarray, ...]] = []
        held, d, row = 0, 0, np.arange(len(tok))
        while len(row):
            d += 1
            row = row[row + d < stop[row]]
            row = row[n[row + d] * threshold.numerator <= n[row] * threshold.denominator]
            other = row + d
            meet = (comp[row] != comp[other]) & (home[row] | home[other]) & (~split[row] | (part[row] != part[other]))
            i, j = row[meet], other[meet]
            if signed and len(i):
                ok = _allowed(threshold, _most(flat, start, size, n, i, j), n[i], n[j])
                i, j = i[ok], j[ok]
            met = np.ones(len(i), np.int64)
            if lists is not None and len(i):
                ok, met = lists.first_met(tok, i, j)
                i, j, met = i[ok], j[ok], met[ok]
            found.append((name[i], name[j], met))
            held += len(i)
            if held > HELD_PAIRS or held and not len(row):
                yield counted(*map(list, zip(*found)))
                found, held = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            whole = part if whole is None else pa.concat_tables([whole, part]).combine_chunks()
            edge = np.flatnonzero(_moved(*(whole.column(c).to_numpy() for c in ("tok", "k", "p", "q"))))
            if len(edge) > 1:  # all but the last tile, which may go on
                yield from pairs(whole.slice(0, int(edge[-1])))
                whole = whole.slice(int(edge[-1]))
        if whole is not None and whole.num_rows:
            yield from pairs(whole)

    return run


def _moved(*columns: np.ndarray) -> np.ndarray:
    """Rows that differ from the one before in some column; the first one does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, z): the compressed text of the smallest document of each class in wanted(cls); for a repeated doc_id also its other texts."""
    reps = gathered(wanted.select("cls").distinct().join(classes.select("cls", F.col("rep").alias("doc_id")), "cls").where("doc_id IS NOT NULL"))
    if (many := reps.count()) <= TOLD_IDS:
        found = cut(packed(docs.join(F.broadcast(reps), "doc_id").select("cls", "text")))
        # a scan's task for few texts each would make a small file of a shuffle for each
        return found.coalesce(1 + many // 5000)
    return cut(packed(docs).join(reps, "doc_id").select("cls", "z"))


def _possible(pairs: DataFrame, classes: DataFrame, threshold: Fraction) -> DataFrame:
    """Of pairs (a, b) of classes, those whose bitmaps allow a link, with the similarity `like` that they allow."""
    light = classes.select("cls", "n", "bits")
    left, right = (light.select(*(F.col(c).alias(d) for c, d in zip(light.columns, (x, f"n_{x}", f"bits_{x}")))) for x in "ab")
    return pairs.join(left, "a").join(right, "b").mapInArrow(tidy(_bounded(threshold)), "a long, b long, like double")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: Fraction) -> DataFrame:
    """Of pairs (a, b) of classes with `texts`, those that link.

    Pairs go by their class a; one with more than GROUP pairs is dealt out, with a copy of its text for each GROUP.
    """
    # few pairs go to the texts, so that texts move once, to their group; more pairs and the texts meet by class first
    told = F.broadcast if pairs.count() <= FEW else (lambda df: df)
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    side = told(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")))
    own = told(many).join(texts.withColumnRenamed("cls", "a"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "z")
    rows = own.unionByName(side.join(texts.withColumnRenamed("cls", "b"), "b"))
    # a null b comes first
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "b").mapInArrow(tidy(_exact(threshold)), "a long, b long")


def _grouped(links: DataFrame) -> DataFrame:
    joined = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return joined.select(F.col("node").alias("cls"), F.col("component").alias("comp"))


def _with_component(df: DataFrame, groups: DataFrame | None, cls: str = "cls", comp: str = "comp") -> DataFrame:
    if groups is None:
        return df.withColumn(comp, F.col(cls))
    return df.join(groups.select(F.col("cls").alias(cls), F.col("comp").alias(comp)), cls, "left").withColumn(comp, F.coalesce(comp, cls))


def _stars(hot: DataFrame, docs: DataFrame, classes: DataFrame, threshold: Fraction) -> tuple[DataFrame | None, DataFrame | None]:
    """(links, components) of hot(tok, cls, n): a shortcut before the tiles that joins most of a large group of near copies.

    Each round takes a class of each bucket by hash as its centre. Of all centres of its buckets, a class is compared
    with the one in another component that is most like it by their bitmaps. What doesn't link meets other centres in
    the next round, and at last the tiles, so no link depends on this.
    """
    p, q = threshold.numerator, threshold.denominator
    links = groups = texts = None
    for k in range(ROUNDS):
        own = _with_component(hot, groups)
        one = F.min_by(F.struct(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a")), F.xxhash64("cls", "tok", F.lit(k))).alias("one")
        centres = own.groupBy("tok").agg(one, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("tok", "one.*")
        met = own.join(centres, "tok").where(f"comp <> comp_a AND least(n, n_a) * {q} >= greatest(n, n_a) * {p}").select("a", F.col("cls").alias("b")).distinct()
        pairs = gathered(_possible(met, classes, threshold).groupBy("b").agg(F.max_by("a", F.struct("like", "a")).alias("a")).select("a", "b"))
        tried = pairs.count()
        if not tried:
            break
        texts = texts if texts is not None else _texts(docs, classes, hot)
        new = gathered(_verified(pairs, texts, threshold))
        linked = new.count()
        if linked:
            links = new if links is None else links.unionByName(new)
            groups = gathered(_grouped(links))
        if linked < WORTH * tried:
            break
    return links, groups


def _tiled(rows: DataFrame, threshold: Fraction, more: DataFrame | None = None, together: bool = False) -> DataFrame:
    """(a, b, met): pairs of rows(tok, cls, n, comp, rows) that meet in tiles; rows: how many the bucket of tok has. See _tiles.

    more(cls, bits, toks): bitmaps and tokens of the classes; bitmaps may also stand in the rows. together: a partition
    of rows has all of its buckets' rows, so tiles are made in place.
    """
    signed, listed = more is not None or "bits" in rows.columns, more is not None
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(BAND)))
    reach = int(np.ceil(np.log(float(1 / threshold)) / np.log(BAND) - 1e-9))
    rows = rows.withColumns({"n": F.col("n").cast("long"), "band": band, "parts": F.ceil(F.col("rows") / TILE_ROWS)}).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
    # a row is at home in its band's tile and a guest in those of the bands below; with parts > 1 in each pair of parts
    other = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    tiles = rows.withColumn("k", F.explode(F.sequence(F.col("band") - reach, F.col("band")))).withColumn("o", F.explode(other))
    tiles = tiles.select("tok", "k", F.least("part", "o").alias("p"), F.greatest("part", "o").alias("q"), "cls", "n", "comp", "part", (F.col("k") == F.col("band")).alias("home"), *(["bits"] if "bits" in rows.columns else []))
    if more is not None:
        tiles = tiles.join(more, "cls")
    tile = ("tok", "k", "p", "q")
    return (tiles if together else tiles.repartition(*tile)).sortWithinPartitions(*tile, "n", "cls").mapInArrow(tidy(_tiles(threshold, signed, listed)), "a long, b long, met long")


def _often_enough(threshold: Fraction) -> str:
    """Condition on n_a, n_b and met, the shingles that both prefixes hold.

    Of the two sets let x be the one whose prefix ends first. A common member is in both prefixes, or one of x's
    ceil(t |x|) - 1 members beyond its prefix; a link needs t / (1 + t) (n_a + n_b) common members.
    """
    p, q = threshold.numerator, threshold.denominator
    return f"met >= ceil({p} * (n_a + n_b) / {p + q}D) - ceil({p} * greatest(n_a, n_b) / {q}D) + 1"


def _joined(docs: DataFrame, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """See ngram_jaccard_classes: rows (doc_id, n_shingles, cls) and classes (cls, rep, component); rep is the smallest doc_id of the class."""
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = cut(docs.mapInArrow(tidy(_profile), PROFILE))
    rows = base.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "cls")
    often = base.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "id").limit(MOST_FREQUENT).select("id").toPandas()
    told = spark.sparkContext.broadcast(np.sort(often["id"].to_numpy(np.int64).view(np.uint64)).tobytes())
    classes = cut(base.where("kind = 0 AND cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    # rows of a frequent shingle are dealt out, all others of a shingle come together and are counted; a checkpoint keeps
    # partitions as they are, so cold buckets (all rows have salt 0) need no other shuffle to be tiled
    entries = docs.mapInArrow(tidy(_entries(told, threshold)), ENTRIES).withColumn("salt", F.when(F.col("told"), F.pmod(F.xxhash64("cls"), F.lit(SALTS))).otherwise(F.lit(0)))
    entries = entries.repartition("tok", "salt").distinct()
    shared = cut(entries.withColumn("rows", F.count("*").over(Window.partitionBy("tok", "salt"))).where("told OR rows > 1").withColumn("hot", F.col("told") | (F.col("rows") > HOT_ROWS)).select("tok", "cls", "n", "hot", "rows"))
    hot = shared.where("hot").select("tok", "cls", "n")
    hot = gathered(hot.join(hot.groupBy("tok").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("tok"), "tok"))
    in_hot = hot.select("cls").distinct()
    signed = gathered(classes.join(F.broadcast(in_hot) if hot.count() <= FEW else in_hot, "cls"))
    links, groups = _stars(hot, docs, signed, threshold)
    # what is left between components: hot buckets with bitmaps, as most pairs there would be between unlike sets
    own = _with_component(hot, groups)
    open_ = own.groupBy("tok").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("rows")).where("low <> high")
    own = own.join(open_.select("tok", "rows"), "tok")
    met = _tiled(own, threshold, signed.select("cls", "bits").join(own.groupBy("cls").agg(F.array_sort(F.collect_set("tok")).alias("toks")), "cls"))
    # the pairs of a small bucket are few for each row; in a larger one most would be between texts that share a passage
    cold = shared.where("NOT hot").select("tok", "cls", "n", F.col("cls").alias("comp"), "rows")
    met = met.unionByName(_tiled(cold.where(F.col("rows") <= COLD_ROWS), threshold, together=True))
    warm = _with_component(cold.where(F.col("rows") > COLD_ROWS).drop("comp"), groups).join(classes.select("cls", "bits"), "cls")
    met = met.unionByName(_tiled(warm.repartition("tok"), threshold, together=True))
    met = met.groupBy("a", "b").agg(F.sum("met").alias("met"))
    size = classes.select("cls", "n")
    for x in "ab":
        met = met.join(size.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}")), x)
    near = met.where(_often_enough(threshold)).select("a", "b")
    if groups is not None:
        near = _with_component(_with_component(near, groups, "a", "c"), groups, "b", "d").where("c <> d").select("a", "b")
    near = gathered(_possible(near, classes, threshold).select("a", "b"))
    # each pair goes by the class with more pairs, so no class is the other side of many
    degree = near.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count("*").alias("d"))
    for x in "ab":
        near = near.join(degree.select(F.col("x").alias(x), F.col("d").alias(f"d_{x}")), x)
    near = near.select(*(F.when(F.col("d_a") >= F.col("d_b"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in ("ab", "ba")))
    texts = _texts(docs, classes, near.select(F.explode(F.array("a", "b")).alias("cls")))
    more = cut(_verified(near, texts, threshold))
    linked = _grouped(more if links is None else links.unionByName(more))
    named = _with_component(classes.select("cls", "rep"), linked, "cls", "component")
    return rows, named


def ngram_jaccard_classes(docs: DataFrame, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id. Other columns of docs aren't read.

    A text's words are split at ASCII white space and A-Z is folded; its set holds the 64-bit hashes of its 5-word
    shingles, or of the whole sequence if it has fewer words. Rows link at a Jaccard similarity of `threshold` or
    more; component_id is the smallest doc_id that links reach. Empty or null texts link with nothing and keep their
    own id. A null doc_id never names a component: it has that of its copies, and rows with a null doc_id and no copy
    with an id link with nothing and have null. Repeated rows are
    rows of their own, in one component. An empty table gives an empty result.

    1. A pass gives each row's set a class, so that copies are one from here on, and the frequent shingles.
    2. Prefixes (see `prefix`) meet by shingle. Hot buckets, of a frequent shingle or of many classes, go through star
       rounds (see `_stars`) that join large groups of near copies without comparing all their pairs.
    3. Tiles by shingle and size band pair the classes that are still in different components, and count in how many
       tiles a pair met. Rows of all but the smallest buckets carry bitmaps, so that unlike pairs end in their tile; in
       hot ones a pair comes out of one tile, with its count. Too few for the sizes (see `_often_enough`), or bitmaps that bound the intersection too low:
       no link. What is left is intersected. So no link between components is lost.
    """
    rows, named = _joined(docs, threshold)
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("cls", "component_id")
    return rows.join(named, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With each text's class as __cls; null for a text without words."""
    for batch, i, sets in _sets(batches):
        yield pa.record_batch([*batch.slice(i, len(sets)).columns, pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())], names=[*batch.schema.names, "__cls"])


def keep_one_of_each(docs: DataFrame, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """Of each component one row of docs: that of the smallest doc_id, then of the smallest class of texts.

    So unlike texts under one doc_id all stay, and copies without a doc_id fall together, to those with one if there are
    any. Of rows with the chosen doc_id and class that of the smallest hash of the text stays. Texts without words link
    with nothing and all stay.
    """
    _, named = _joined(docs, threshold)
    chosen = named.groupBy("component").agg(F.min(F.struct(F.isnull("rep").alias("none"), "rep", "cls")).alias("one"))
    chosen = cut(chosen.select(F.col("one.rep").alias("__rep"), F.col("one.cls").alias("__cls")))
    texts = docs.withColumns({"text": F.col("text").cast("string"), "__rep": F.col("doc_id").cast("long")})
    own = texts.mapInArrow(tidy(_named), T.StructType([*texts.schema, T.StructField("__cls", T.LongType())]))
    with_id = own.where("__rep IS NOT NULL").join(chosen, ["__rep", "__cls"], "left_semi")
    # partial minima before the join: all copies without an id have one key
    least = F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("one")
    without = own.where("__rep IS NULL AND __cls IS NOT NULL").groupBy("__cls").agg(least).join(chosen.where("__rep IS NULL"), "__cls", "left_semi")
    one = with_id.groupBy("__rep", "__cls").agg(least).select("one.*").unionByName(without.select("one.*"))
    return one.unionByName(own.where("__cls IS NULL").select(*docs.columns))
