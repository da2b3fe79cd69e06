"""Token ids by the tokenizers library, each distinct stretch of text between spaces encoded once per worker."""

from __future__ import annotations

import json
import os
import re
import weakref
from array import array
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stretches that a worker remembers (about 250 bytes each); beyond that it starts anew.
REMEMBERED = 500_000
#: Beyond Latin letters, and the one of them that grows in lower case: here normal forms and case may depend on the neighbours.
BEYOND_LATIN = re.compile("[^\x00-\u012f\u0131-\u024f]")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models have for each byte: printable ones stand for themselves, the others count on from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()
SPACE_LETTER = BYTE_LETTERS[32]
#: The matches of the byte-level pattern in printable ASCII without spaces but one before it.
BYTE_LEVEL_ASCII = re.compile("'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+")


def stretches(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct stretches between single spaces, which of them stands at each place, and the texts' offsets in the places."""
    parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = parts.flatten().dictionary_encode()
    # by NumPy, as to_pylist makes a scalar of each first
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), parts.offsets.to_numpy()


def joined(made: list[bytes], place: np.ndarray, at: np.ndarray, kind: np.dtype) -> list[bytes]:
    """The ids (of `kind`) of rows: made[p] for each p of place[at[i]:at[i + 1]]."""
    ids, size = np.frombuffer(b"".join(made), kind), np.array([len(m) for m in made], np.int64) // kind.itemsize
    n = size[place]
    ends = np.cumsum(n)
    narrow = np.int32 if max(len(ids), int(ends[-1]) if len(ends) else 0) < 1 << 31 else np.int64
    from_ = np.repeat(((np.cumsum(size) - size)[place] - (ends - n)).astype(narrow), n)
    from_ += np.arange(len(from_), dtype=narrow)
    raw, bounds = ids[from_].tobytes(), (np.concatenate(([0], ends))[at] * kind.itemsize).tolist()
    return [raw[a:b] for a, b in zip(bounds, bounds[1:])]


class _Known(dict):
    """The ids of keys; those of a new one are made when it is looked up."""

    def __init__(self, encoder: _Encoder):
        super().__init__()
        self.encoder = weakref.proxy(encoder)  # so that both go at once

    def __missing__(self, key):
        ids = self[key] = self.encoder.made(key)
        return ids


class _Encoder:
    """Remembers the ids (of `width` bytes, little-endian) of stretches of text that the tokenizer treats on their own."""

    #: Cuts a word of printable ASCII into the pattern's matches, where they are known.
    matches = None

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.known, self.parts = Tokenizer.from_file(path), {2: "H", 4: "I"}[width], _Known(self), {}
        self.tokenize = self.tokenizer.model.tokenize

    def whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, word: str) -> bytes:
        """The ids of a word, cut in a core and the ASCII punctuation at its end.

        Both tokenizers' patterns end a match between a letter or digit and punctuation. A core of letters alone (after
        one space, perhaps) and such an end are one match each, so they go to the library's merges straight, without its
        far dearer normalizer and pattern; all else, words beyond Latin or with `<|` as in special tokens too, goes to
        the whole library.
        """
        core, latin, parts = word, word.isascii() or not BEYOND_LATIN.search(word), self.parts
        if latin and "<|" not in word:
            core = word.rstrip(punctuation)
            if not core[-1:].isalnum():
                core = word
        made = parts.get(core)
        if made is None:
            if latin and core.removeprefix(" ").isalpha():
                made = self.merged(core)
            elif self.matches is not None and core.isascii() and core.isprintable() and "<|" not in core:
                made = b""
                for match in self.matches(core):
                    ids = parts.get(match)
                    if ids is None:
                        ids = parts[match] = self.merged(match)
                    made += ids
            else:
                made = array(self.kind, self.tokenizer.encode_batch_fast([core], add_special_tokens=False)[0].ids).tobytes()
            parts[core] = made
        if len(core) < len(word):
            tail = word[len(core) :]
            end = parts.get(tail)
            if end is None:
                end = parts[tail] = self.merged(tail)
            made += end
        return made

    def merged(self, match: str) -> bytes:
        # of ASCII letters and punctuation only the space has another letter
        letters = match.replace(" ", SPACE_LETTER) if match.isascii() else match.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array(self.kind, [t.id for t in self.tokenize(letters)]).tobytes()

    def room(self) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()


class ByteLevel(_Encoder):
    """For byte-level tokenizers whose pattern joins one space to what follows and keeps no context otherwise.

    A text is cut before each single space between two other characters; no token spans such a cut. Texts in which a
    space has white space beside it are encoded whole.
    """

    def __init__(self, path: str, width: int):
        super().__init__(path, width)
        pre = self.tokenizer.pre_tokenizer
        own = json.loads(pre.__getstate__()) if pre is not None and self.tokenizer.normalizer is None else {}
        if own.get("type") == "ByteLevel" and own.get("use_regex") and not own.get("add_prefix_space"):
            self.matches = BYTE_LEVEL_ASCII.findall
            self.line_end = self.whole("\n")

    def made(self, key: str) -> bytes:
        if not key or key[0].isspace() or key[-1].isspace():
            raise KeyError(key)
        if self.matches is not None and "\n" in key:
            lines = key.split("\n")  # a line's end between two other characters is a match of its own
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                return self.line_end.join([self.ids(" " + lines[0]), *map(self.ids, lines[1:])])
        return self.ids(" " + key)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; each stretch after the first goes with the space before it, and distinct ones are looked up once."""
        return self.by_stretches(texts, True)

    def by_stretches(self, texts: list[str], first_alone: bool) -> list[bytes]:
        self.room()
        names, place, at = stretches(texts)
        used = np.ones(len(place), bool)
        if first_alone:
            used[at[:-1]] = False
        met = np.zeros(len(names), bool)
        met[place[used]] = True
        made, odd, known = [b""] * len(names), np.zeros(len(names), bool), self.known
        for k in np.flatnonzero(met).tolist():
            try:
                made[k] = known[names[k]]
            except KeyError:  # white space beside a space, or at an end
                odd[k] = True
        before = np.concatenate(([0], np.cumsum(odd[place] & used)))[at]
        whole = before[1:] > before[:-1]
        ends = np.concatenate(([0], np.cumsum(used)))[at]
        out = joined(made, place[used], ends, np.dtype("<" + {"H": "u2", "I": "u4"}[self.kind]))
        for i, (text, first) in enumerate(zip(texts, place[at[:-1]].tolist())):
            if not text:
                out[i] = b""
            elif whole[i]:
                out[i] = self.all_of(text)
            elif first_alone:
                first = names[first]
                out[i] = self.all_of(text) if first[-1:].isspace() or not first else self.whole(first) + out[i]
        return out

    def all_of(self, text: str) -> bytes:
        return self.whole(text)


class WordLevel(_Encoder):
    """For tokenizers that drop white space and case and keep no context across it: words at ASCII white space stand alone."""

    @staticmethod
    def folded(word: bytes) -> str:
        """In lower case, as the tokenizer has it; beyond Latin that is left to the tokenizer."""
        text = word.decode()
        return text.lower() if word.isascii() or not BEYOND_LATIN.search(text) else text

    def made(self, key: bytes) -> bytes:
        return self.ids(self.folded(key))

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            self.room()
            out.append(b"".join(map(self.known.__getitem__, text.encode().split())))
        return out


@lru_cache(maxsize=1)
def encoder(kind: str, path: str, width: int) -> _Encoder:
    return {"bytes": ByteLevel, "words": WordLevel}[kind](path, width)
