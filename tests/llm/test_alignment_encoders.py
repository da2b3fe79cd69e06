"""The alignment's encoders: words met again outlive the turns of their memory, and spellings are compared exactly."""

import random
from array import array

import numpy as np
import pytest

from lodestrand.llm import alignment, piece_codec, queries, tokens

A, B = (queries.tokenizer(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.mark.parametrize("young", [250_000, 20])
def test_ids_do_not_depend_on_what_is_remembered(monkeypatch, young):
    monkeypatch.setattr(alignment, "YOUNG", young)
    rnd = random.Random(3)
    rows = [" ".join("".join(rnd.choices("abé.\n▁<9", k=rnd.randrange(4))) for _ in range(rnd.randrange(9))) for _ in range(2000)]
    first, second, plain = alignment.SpacedByteLevel(A), alignment.SpacedPieces(B), piece_codec.PieceCodec(B)
    for i in range(0, len(rows), 40):
        some = rows[i : i + 40]
        want = [array("H", first.tokenizer.encode(" " + t, add_special_tokens=False).ids if t else []).tobytes() for t in some]
        assert first.encode(some) == want
        assert second.encode(some) == [plain.encode([t])[0] for t in some]


def test_words_met_again_are_made_once(monkeypatch):
    monkeypatch.setattr(alignment, "YOUNG", 3)
    made, ids, learnt, merged = [], tokens.ByteLevel.ids, [], piece_codec.PieceCodec.merged
    monkeypatch.setattr(tokens.ByteLevel, "ids", lambda self, word: made.append(word) or ids(self, word))
    monkeypatch.setattr(piece_codec.PieceCodec, "merged", lambda self, words: learnt.extend(words) or merged(self, words))
    first, second = alignment.SpacedByteLevel(A), alignment.SpacedPieces(B)
    del made[:], learnt[:]
    for k in range(20):
        text = f"again and new{k} other{k}"
        assert first.encode([text]) and second.encode([text])
    assert made.count(" again") == 1 and learnt.count("▁again") == 1
    assert len(first.known) + len(first.old) < 16 and len(second.stretches) + len(second.old) < 16


def test_spelling():
    spelling = alignment.Spelling([b" a", b"b", b"", b" ab"])
    ids = lambda *x: np.array(x, np.uint16)
    assert spelling.all_right(["ab", "", "a"], [ids(0, 1), ids(), ids(2, 0)]) == [True] * 3
    # the same bytes in all, the border between the texts elsewhere; a wrong letter; none at all
    assert spelling.all_right(["a", "b", "ab"], [ids(0, 1), ids(1), ids(3)]) == [False, False, True]
    assert spelling.all_right(["bb", "ab"], [ids(0, 1), ids(3)]) == [False, True]
    assert spelling.all_right(["a", ""], [ids(), ids()]) == [False, True]
    assert spelling.all_right([], []) == []
