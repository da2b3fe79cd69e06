"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat arrays of symbols."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import ready, tidy

#: Stretches between spaces that a worker remembers the ids of (about 200 bytes each), and words that are merged at once.
REMEMBERED, AT_ONCE = 500_000, 50_000
MARK = "▁"
NEVER = np.int64(1 << 40)


class PieceCodec:
    """A byte-fallback BPE model without normalisation that marks spaces, and puts one before the text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(size)]
        ids = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in ids):
            raise ValueError("a piece goes beyond a word")
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.size = size
        #: ids as they are remembered
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<i4")
        score = np.array([model.get_score(i) for i in range(size)])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)  # equal scores have equal ranks
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    pairs[ids[p[:k]] * size + ids[p[k:]]] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # a dense first filter: which symbols can stand left, which right
        self.left, self.right = np.zeros(size, bool), np.zeros(size, bool)
        self.left[self.keys // size] = True
        self.right[self.keys % size] = True
        self.chars = np.full(0x110000, -1, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        self.raw = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        if model.unk_id() >= 0:
            self.raw[model.unk_id()] = " ⁇ ".encode()
        self.sizes = np.array([len(r) for r in self.raw], np.int64)
        self.marked = np.array([p.startswith(MARK) for p in self.pieces])
        self.stretches: dict[str, bytes] = {}

    def pair_ranks(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the rank of its symbol's merge with the next one, or NEVER, and what they make."""
        n = len(symbol)
        rank, made = np.full(n, NEVER), np.zeros(n, np.int64)
        a, b = symbol[:-1], symbol[1:]
        low = self.size
        at = np.flatnonzero((word[1:] == word[:-1]) & (a < low) & (b < low))
        at = at[self.left[a[at]] & self.right[b[at]]]
        key = a[at] * low + b[at]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[place] == key
        at, place = at[hit], place[hit]
        made[at] = self.made[place]
        rank[at] = self.rank[made[at]]
        return rank, made

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word: rounds of merging each word's pairs of the least rank, leftmost first, until none is left."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        symbol = np.where(self.chars[code] >= 0, self.chars[code], self.size + code)
        done_symbol, done_word = [], []
        rank, made = self.pair_ranks(symbol, word)
        while len(symbol):
            head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            spread = np.diff(np.append(head, len(word)))
            least = np.minimum.reduceat(rank, head)
            ended = least == NEVER
            if ended.any():  # compaction: what has no pair leaves
                gone = np.repeat(ended, spread)
                done_symbol.append(symbol[gone])
                done_word.append(word[gone])
                stay = ~gone
                symbol, word, rank, made = symbol[stay], word[stay], rank[stay], made[stay]
                if not len(symbol):
                    break
                least, spread = least[~ended], spread[~ended]
            best = np.repeat(least, spread)
            chosen = rank == best
            # of pairs that overlap, every other one from the left
            start = chosen & ~np.concatenate(([False], chosen[:-1]))
            first = np.maximum.accumulate(np.where(start, np.arange(len(chosen)), 0))
            chosen &= (np.arange(len(chosen)) - first) % 2 == 0
            new_symbol, new_word, new_rank, new_made = self._apply(symbol, word, made, chosen)
            # merged at once only if no new pair comes before those that waited; else the leftmost alone
            several = np.add.reduceat(chosen, np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))), dtype=np.int64) > 1
            if several.any():
                new_least = np.minimum.reduceat(new_rank, np.flatnonzero(np.concatenate(([True], new_word[1:] != new_word[:-1]))))
                early = several & (new_least <= least)
                if early.any():
                    head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                    count = np.cumsum(chosen)
                    before = np.repeat(count[head] - chosen[head], spread)
                    chosen &= ~np.repeat(early, spread) | (count - before == 1)
                    new_symbol, new_word, new_rank, new_made = self._apply(symbol, word, made, chosen)
            symbol, word, rank, made = new_symbol, new_word, new_rank, new_made
        symbol = np.concatenate(done_symbol) if done_symbol else np.zeros(0, np.int64)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        symbol, word = symbol[order], word[order]
        symbol, word = self._fallback(symbol, word)
        bounds = np.searchsorted(word, np.arange(len(words) + 1))
        symbol = symbol.astype(np.int32)
        return [symbol[bounds[i] : bounds[i + 1]] for i in range(len(words))]

    def _apply(self, symbol, word, made, chosen):
        symbol = np.where(chosen, made, symbol)
        stay = ~np.concatenate(([False], chosen[:-1]))
        symbol, word = symbol[stay], word[stay]
        return symbol, word, *self.pair_ranks(symbol, word)

    def _fallback(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their UTF-8 bytes."""
        c = symbol - self.size
        n = np.where(c < 0, 1, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
        if not (c >= 0).any():
            return symbol, word
        at = np.repeat(np.arange(len(symbol)), n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        c, n = c[at], n[at]
        first = np.where(n == 1, c, (0xF00 >> n & 0xFF) | (c >> 6 * (n - 1)))
        byte = np.where(k == 0, first, 0x80 | (c >> np.maximum(6 * (n - 1 - k), 0)) & 0x3F)
        return np.where(c < 0, symbol[at], self.bytes[np.clip(byte, 0, 255)]), word[at]

    #: A word: marks and what follows them up to the next mark or line end; a line end merges with nothing.
    WORD = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")

    def learn(self, stretches: list[str]) -> dict[str, bytes]:
        """The ids of stretches without spaces, each with the mark before it."""
        whole = sorted((k for k in stretches if "\n" not in k and MARK not in k), key=len)
        out = {}
        for i in range(0, len(whole), AT_ONCE):
            some = whole[i : i + AT_ONCE]
            out.update(zip(some, self.merged([MARK + k for k in some])))
        several = {k: self.WORD.findall(MARK + k) for k in stretches if k not in out}
        words = sorted({w for all_ in several.values() for w in all_}, key=len)
        made = dict(zip(words, self.merged(words))) if words else {}
        for k, all_ in several.items():
            out[k] = b"".join(map(made.__getitem__, all_))
        return out

    def merged(self, words: list[str]) -> list[bytes]:
        made = self.merge(words)
        ends = np.cumsum([len(m) for m in made]) * self.kind.itemsize
        raw = np.concatenate(made).astype(self.kind).tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def whole(self, text: str) -> bytes:
        """The ids of a text with spaces beside spaces or marks, or at an end."""
        words = self.WORD.findall(MARK + text.replace(" ", MARK))
        new = sorted(set(words), key=len)
        made = dict(zip(new, self.merged(new)))
        return b"".join(map(made.__getitem__, words))

    def room(self) -> None:
        if len(self.stretches) > REMEMBERED:
            self.stretches.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, of `kind`, made stretch by stretch between spaces, as no piece has a mark inside."""
        known = self.stretches
        self.room()
        names, place, at = tokens.stretches(texts)
        made = list(map(known.get, names))
        new = [k for k, ids in enumerate(made) if ids is None and names[k] and not names[k].endswith(MARK)]
        learnt = self.learn([names[k] for k in new])
        known.update(learnt)
        for k in new:
            made[k] = learnt[names[k]]
        odd = np.array([ids is None for ids in made])
        before = np.concatenate(([0], np.cumsum(odd[place])))[at]
        out = tokens.joined([ids or b"" for ids in made], place, at, self.kind)
        for i in np.flatnonzero(before[1:] > before[:-1]).tolist():  # empty, spaces beside spaces or marks, or at an end
            out[i] = self.whole(texts[i]) if texts[i] else b""
        return out

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of ids[at[i]:at[i + 1]]: pieces and bytes one after the other, marks as spaces, without the one put before the text."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        ends = np.concatenate(([0], np.cumsum(self.sizes[ids])))[at]
        first = np.minimum(at[:-1], max(len(ids) - 1, 0))
        skip = self.marked[ids[first]] & (at[1:] > at[:-1]) if len(ids) else np.zeros(len(at) - 1, bool)
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip((ends[:-1] + skip).tolist(), ends[1:].tolist())]


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


BATCH = 256


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                made = model.encode([t or "" for t in part.column("text").to_pylist()])
                offsets = np.concatenate(([0], np.cumsum([len(m) for m in made]) // model.kind.itemsize)).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), model.kind).astype(np.int32)))
                yield pa.record_batch([part.column("row"), ids], names=["row", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                ids = part.column("ids")
                at = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)))
                text = pa.array(model.decode(ids.flatten().to_numpy(), at), pa.string())
                yield pa.record_batch([part.column("row"), part.column("ids"), text], names=["row", "ids", "decoded"])

    return run


def encode_pieces(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(row, ids) for each row of docs(text, ...): the columns `keep` and the text's ids, without begin or end.

    A null or empty text has no ids. Rows are dealt with one by one, so repeated rows, ties and empty tables are
    nothing special, and no other column is read. A very long text costs memory in proportion to itself.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.struct(*(docs[c] for c in keep)).alias("row"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(tidy(_encode(model)), T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """(row, ids, decoded) for (row, ids): the text of the ids."""
    encoded = encoded.select("row", "ids")
    return encoded.mapInArrow(tidy(_decode(model)), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
