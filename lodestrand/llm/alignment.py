"""Two tokenizers' tokens of each text aligned by a sweep over the byte offsets where tokens end."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import piece_codec, tokens
from .common import blocks, cut, text_bytes, tidy

#: Stands for a null doc_id while rows are dealt out.
NULL_ID = -(1 << 63)
#: Tokens of one row of events; links of a group that are made one by one (beyond, by its distinct ids); rows whose links are read at once.
EVENTS, LINKS, TEXTS = 8192, 1 << 14, 256
#: Bytes of texts that are encoded at once (a longer text alone): the more, the fewer distinct stretches are looked up.
ENCODED_BYTES = 4 << 20
#: Stretches that either side remembers since it last set apart older ones; of those, what isn't met again goes at the next time.
YOUNG = 250_000
#: Distinct id pairs whose counts a task holds at once (about 17 bytes each); more are looked up in several passes.
PAIRS = 4_000_000
A, B = 0, 1
EVENT = "doc long, twin long, at long, side long, ok boolean, copies long, ids binary"
SWEPT = "doc long, twin long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


class SpacedByteLevel(tokens.ByteLevel):
    """Encodes a space and the text; strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path, 2)
        self.old: dict[str, bytes] = {}
        self.tokenizer.encode_special_tokens = True
        byte_of = {letter: b for b, letter in tokens.BYTE_LETTERS.items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        if len(vocabulary) > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.raw = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.raw[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()

    def room(self) -> None:
        if len(self.known) > YOUNG:
            self.old = dict(self.known)
            self.known.clear()
        if len(self.parts) > tokens.REMEMBERED:
            self.parts.clear()

    def made(self, key: str) -> bytes:
        ids = self.old.pop(key, None)
        return super().made(key) if ids is None else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.by_stretches(texts, False)

    def all_of(self, text: str) -> bytes:
        return self.whole(" " + text)


class SpacedPieces(piece_codec.PieceCodec):
    """Encodes a text to 16-bit ids; it puts the space before the text itself."""

    def __init__(self, path: str):
        super().__init__(path)
        self.old: dict[str, bytes] = {}
        if self.kind.itemsize > 2:
            raise ValueError("ids need more than 16 bits")

    def room(self) -> None:
        if len(self.stretches) > YOUNG:
            self.old = dict(self.stretches)
            self.stretches.clear()

    def learn(self, stretches: list[str]) -> dict[str, bytes]:
        met = {k: self.old.pop(k) for k in stretches if k in self.old}
        return met | super().learn([k for k in stretches if k not in met])


class Spelling:
    """The bytes of a side's tokens: one after the other in `flat`, from `start`, `size` of each."""

    def __init__(self, raw: list[bytes]):
        self.raw, self.flat, self.size = raw, np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def all_right(self, texts: list[str], made: list[np.ndarray]) -> list[bool]:
        """For each text whether its ids spell a space and the text (an empty one: no bytes needed). All are compared at once, and one by one only if some differ."""
        want = [b" " + t.encode() if t else b"" for t in texts]
        ids = np.concatenate([*(m for m, w in zip(made, want) if w), np.zeros(0, np.uint16)])
        n = self.size[ids]
        ends = np.cumsum(n)
        last = np.cumsum([len(m) for m, w in zip(made, want) if w], dtype=np.int64)
        if len(n) and np.array_equal(np.concatenate(([0], ends))[last], np.cumsum([len(w) for w in want if w])):
            at = np.repeat((self.start[ids] - (ends - n)), n)
            at += np.arange(len(at))
            if np.array_equal(self.flat[at], np.frombuffer(b"".join(want), np.uint8)):
                return [True] * len(texts)
        return [not w or b"".join(map(self.raw.__getitem__, m.tolist())) == w for m, w in zip(made, want)]


@lru_cache(maxsize=1)
def first_model(path: str) -> SpacedByteLevel:
    return SpacedByteLevel(path)


@lru_cache(maxsize=1)
def second_model(path: str) -> SpacedPieces:
    return SpacedPieces(path)


@lru_cache(maxsize=1)
def token_bytes(path_a: str, path_b: str) -> tuple[list[bytes], list[bytes]]:
    return SpacedByteLevel(path_a).raw, piece_codec.PieceCodec(path_b).raw


def _events(side: int, path: str):
    """Rows of EVENT: each new text's ids on one side, EVENTS to a row, with the byte offset of the first one's start.

    Rows of one doc_id and text go out once for each task, with how many there are at offset -1. ok: the tokens' bytes
    are those of a space and the text; the ids of others stay away.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (second_model if side == A else first_model).cache_clear()
        model = (first_model if side == A else second_model)(path)
        spelling = Spelling(model.raw)
        sizes = spelling.size
        pack, met = zstandard.ZstdCompressor(level=3).compress, {}
        for batch in batches:
            for i, j in blocks(text_bytes(batch.column("text"))[1], ENCODED_BYTES):
                part, rows = batch.slice(i, j - i), []
                keys = list(zip(part.column("doc").to_pylist(), part.column("twin").to_pylist()))
                fresh = []
                for k, key in enumerate(keys):
                    met[key] = met.get(key, 0) + 1
                    if met[key] == 1:
                        fresh.append(k)
                texts = part.column("text").take(pa.array(fresh, pa.int32())).to_pylist()
                made = [np.frombuffer(ids, np.uint16) for ids in model.encode(texts)]
                for k, text, ids, ok in zip(fresh, texts, made, spelling.all_right(texts, made)):
                    at = 0
                    for j in range(0, len(ids) if ok else 1, EVENTS) if text else (0,):
                        some = ids[j : j + EVENTS] if ok else ids[:0]
                        rows.append((*keys[k], at, side, ok, 0, pack(some.tobytes())))
                        at += int(sizes[some].sum())
                if rows:
                    yield pa.record_batch(list(map(pa.array, zip(*rows))), names=["doc", "twin", "at", "side", "ok", "copies", "ids"])
        if side == A and met:
            keys = list(met)
            for i in range(0, len(keys), 10_000):
                some = keys[i : i + 10_000]
                rows = [(*k, -1, side, True, met[k], pack(b"")) for k in some]
                yield pa.record_batch(list(map(pa.array, zip(*rows))), names=["doc", "twin", "at", "side", "ok", "copies", "ids"])

    return run


def events(docs: DataFrame, side: int, path: str) -> DataFrame:
    """Rows of EVENT for docs(doc, twin, text) on one side."""
    return docs.mapInArrow(tidy(_events(side, path), remembers=True), EVENT)


class Sweep:
    """The state of one document: what is open on either side, totals, a running digest, the links met so far.

    Tokens of a side stay open until a token of the other side ends at the same byte; all before it is then a group and
    leaves. So the state is one row of events of each side besides the open group, and the document's distinct links.
    """

    def __init__(self, key: tuple[int, int], sizes: tuple[np.ndarray, np.ndarray], names: tuple[np.ndarray, tuple[int, int, int, int]]):
        self.key, self.sizes, self.names, self.copies, self.ok = key, sizes, names, 0, True
        self.open = [np.zeros(0, np.uint16)] * 2
        self.ends, self.last = [np.zeros(0, np.int64)] * 2, [-1, -1]
        self.n, self.groups, self.links, self.digest, self.met = [0, 0], 0, 0, None, []

    def take(self, at: int, side: int, ok: bool, copies: int, ids: np.ndarray) -> None:
        self.copies += copies
        self.ok &= ok
        if at <= self.last[side]:  # another task's rows of the same text
            return
        self.last[side] = at
        self.open[side] = np.concatenate((self.open[side], ids))
        self.ends[side] = np.concatenate((self.ends[side], at + np.cumsum(self.sizes[side][ids])))
        (a, b), (ends_a, ends_b) = self.open, self.ends
        if not len(a) or not len(b):
            return
        place = np.minimum(np.searchsorted(ends_b, ends_a), len(b) - 1)
        to_a = np.flatnonzero(ends_b[place] == ends_a)
        if len(to_a):
            to_b = place[to_a] + 1
            to_a += 1
            self.close(a[: to_a[-1]], to_a, b[: to_b[-1]], to_b)
            self.open, self.ends = [a[to_a[-1] :], b[to_b[-1] :]], [ends_a[to_a[-1] :], ends_b[to_b[-1] :]]

    def close(self, a: np.ndarray, to_a: np.ndarray, b: np.ndarray, to_b: np.ndarray) -> None:
        """Groups end after the first to_a tokens of a, and to_b of b."""
        from_a, from_b = np.concatenate(([0], to_a[:-1])), np.concatenate(([0], to_b[:-1]))
        m, n = to_a - from_a, to_b - from_b
        each = m * n
        self.n[A] += len(a)
        self.n[B] += len(b)
        self.groups += len(m)
        self.links += int(each.sum())
        names, (comma_a, bar_a, comma_b, end_b) = self.names
        said, group_a, group_b = np.empty(len(a) + len(b), np.int32), np.repeat(np.arange(len(m)), m), np.repeat(np.arange(len(m)), n)
        name_a, name_b = a.astype(np.int32) + comma_a, b.astype(np.int32) + comma_b
        name_a[to_a - 1] += bar_a - comma_a
        name_b[to_b - 1] += end_b - comma_b
        said[np.arange(len(a)) + from_b[group_a]] = name_a
        said[np.arange(len(b)) + to_a[group_b]] = name_b
        text = names[said].tobytes().translate(None, b"\0")[:-1]
        if self.digest is None:
            self.digest = hashlib.sha256(text)
        else:
            self.digest.update(b";" + text)
        wide, b = a.astype(np.uint32) << np.uint32(16), b.astype(np.uint32)
        one = each == 1
        self.met.append((wide[to_a[one] - 1] | b[to_b[one] - 1], None))
        some = np.flatnonzero(~one & (each <= LINKS))
        for i in range(0, len(some), 1000):  # so many groups' links are made at once
            g = some[i : i + 1000]
            of = np.repeat(g, each[g])
            k = np.arange(len(of)) - np.repeat(np.cumsum(each[g]) - each[g], each[g])
            self.met.append((wide[from_a[of] + k // n[of]] | b[from_b[of] + k % n[of]], None))
        for g in np.flatnonzero(each > LINKS):
            ids_a, times_a = np.unique(wide[from_a[g] : to_a[g]], return_counts=True)
            ids_b, times_b = np.unique(b[from_b[g] : to_b[g]], return_counts=True)
            for x, times in zip(ids_a, times_a):
                self.met.append((x | ids_b, times * times_b))
        if sum(len(k) for k, _ in self.met) > 1 << 20:
            self.met = [self.summed()]

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct links and how often each was met."""
        if not self.met:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.met])
        if all(t is None for _, t in self.met):
            return np.unique(keys, return_counts=True)
        times = np.concatenate([np.ones(len(k), np.int64) if t is None else t for k, t in self.met])
        keys, where = np.unique(keys, return_inverse=True)
        out = np.zeros(len(keys), np.int64)
        np.add.at(out, where, times)
        return keys, out

    def row(self, pack) -> tuple:
        if not self.ok or self.digest is None:
            return (*self.key, self.copies, 0, 0, 0, 0, "", pack(b""), pack(b""))
        keys, times = self.summed()
        steps = np.diff(keys, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T  # like bytes side by side: they pack better
        return (*self.key, self.copies, *self.n, self.groups, self.links, self.digest.hexdigest(), pack(steps.tobytes()), pack(times.astype(np.uint32 if self.links < 1 << 32 else np.uint64).tobytes()))


def _swept(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = token_bytes(path_a, path_b)
        sizes = tuple(np.array([len(x) for x in r]) for r in raw)
        names, starts = [], []
        for side, ends in ((A, b",|"), (B, b",;")):
            for end in ends:
                starts.append(len(names))
                names += [b"%d%c" % (i, end) for i in range(len(raw[side]))]
        names = np.array(names, "S8").view(np.uint64)  # an id below 2 ** 16 and what ends it, zeros after it
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        columns = [c.split()[0] for c in SWEPT.split(", ")]
        state, out = None, []
        for batch in batches:
            for doc, twin, at, side, ok, copies, ids in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if state is None or state.key != (doc, twin):
                    if state is not None:
                        out.append(state.row(pack))
                    state = Sweep((doc, twin), sizes, (names, tuple(starts)))
                state.take(at, side, ok, copies, np.frombuffer(unpack(ids), np.uint16))
                if len(out) >= 500:
                    yield pa.record_batch(list(map(pa.array, zip(*out))), names=columns)
                    out = []
        if state is not None:
            out.append(state.row(pack))
            yield pa.record_batch(list(map(pa.array, zip(*out))), names=columns)

    return run


def links_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, link, times) of a batch of swept rows: a link is the A id times 2 ** 16 and the B id."""
    unpack = zstandard.ZstdDecompressor().decompress
    keys, times = [], []
    for z, t, links in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), batch.column("n_links").to_pylist()):
        steps = np.ascontiguousarray(np.frombuffer(unpack(z), np.uint8).reshape(4, -1).T).view("<u4").ravel()
        keys.append(np.cumsum(steps, dtype=np.uint32))
        times.append(np.frombuffer(unpack(t), np.uint32 if links < 1 << 32 else np.uint64).astype(np.int64))
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    return row, np.concatenate([*keys, np.zeros(0, np.uint32)]), np.concatenate([*times, np.zeros(0, np.int64)])


def _documents_by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, docs): for each link how many of this task's documents hold it."""
    keys, docs, waiting = np.zeros(0, np.uint32), np.zeros(0, np.int64), []

    def together():
        k = np.concatenate([keys, *(k for k, _ in waiting)])
        d = np.concatenate([docs, *(d for _, d in waiting)])
        order = np.argsort(k, kind="stable")
        k, d = k[order], d[order]
        head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
        return k[head], np.add.reduceat(d, head) if len(k) else d

    for batch in batches:
        for i in range(0, batch.num_rows, TEXTS):
            part = batch.slice(i, TEXTS)
            row, pair, _ = links_of(part)
            waiting.append((pair, part.column("copies").to_numpy()[row]))
        if sum(len(k) for k, _ in waiting) > max(1 << 21, len(keys)):
            (keys, docs), waiting = together(), []
    keys, docs = together()
    for i in range(0, len(keys), 50_000):
        yield pa.record_batch([pa.array(keys[i : i + 50_000].astype(np.int64)), pa.array(docs[i : i + 50_000])], names=["pair", "docs"])


def _looked_up(told, first: bool):
    """The swept rows' totals (on the first pass only) with n_best and count_sum over the links that are told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, best = told.value
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                row, pair, times = links_of(part)
                place = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
                hit = keys[place] == pair if len(keys) else np.zeros(len(pair), bool)
                row, place, times = row[hit], place[hit], times[hit]
                sums = np.zeros((2, part.num_rows), np.int64)
                np.add.at(sums[0], row, times * best[place])
                np.add.at(sums[1], row, times * docs[place])
                own = [part.column(c) if first else pa.array(np.zeros(part.num_rows, np.int64)) for c in ("copies", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.record_batch([part.column("doc"), part.column("twin"), *own, part.column("groups_sha256"), pa.array(sums[0]), pa.array(sums[1])], names=["doc", "twin", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    return run


def pair_counts(swept: DataFrame) -> DataFrame:
    """(pair, docs, best): how many documents hold a link, and whether no link of its A id is in more."""
    counts = swept.select("pairs", "times", "n_links", "copies").mapInArrow(tidy(_documents_by_pair), "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = cut(counts.withColumn("a", F.shiftright("pair", 16)))
    return counts.join(counts.groupBy("a").agg(F.max("docs").alias("most")), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc, twin, copies, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) for each different (doc_id, text) of docs.

    The end events of both sides are united, dealt out by document, sorted by offset and swept by a state machine.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("twin"), text.alias("text"))
    both = events(rows, A, path_a).unionByName(events(rows, B, path_b))
    return both.repartition("doc", "twin").sortWithinPartitions("doc", "twin", "at", "side").mapInArrow(tidy(_swept(path_a, path_b)), SWEPT)


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each row of docs(doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    path_a: a byte-level model, which encodes a space and the text; path_b: a piece model, which puts that space itself;
    special tokens' strings are plain text. Offsets at which tokens of both end cut the tokens into groups, and all A-B
    pairs of a group are links. A pair counts the rows of docs that hold it; n_best: links whose count is the highest of
    their A id; count_sum: over links. Null and empty texts, and those whose tokens' bytes aren't the text's, have zeros
    and no digest. Rows of equal doc_id and text count each and have equal results; a null doc_id stays null; other
    columns aren't read; an empty table gives none. A long text is dealt out in rows of EVENTS tokens; what is held of
    it is the open group and its distinct links. (Texts of one doc_id and one 64-bit hash would be taken for equal.)
    """
    swept = cut(aligned(docs, path_a, path_b))
    counts = cut(pair_counts(swept))
    passes = max(1, -(-counts.count() // PAIRS))
    found = None
    for turn in range(passes):
        some = counts.where(F.pmod(F.xxhash64("pair"), F.lit(passes)) == turn).toArrow()  # about PAIRS rows
        order = np.argsort(some["pair"].to_numpy())
        told = swept.sparkSession.sparkContext.broadcast((some["pair"].to_numpy()[order].astype(np.uint32), some["docs"].to_numpy()[order], some["best"].to_numpy()[order]))
        part = swept.mapInArrow(tidy(_looked_up(told, turn == 0)), "doc long, twin long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
        found = part if found is None else found.union(part)
    if passes > 1:
        found = found.groupBy("doc", "twin", "groups_sha256").agg(*(F.sum(c).alias(c) for c in ("copies", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
