"""The piece codec against the sentencepiece library, text by text and in batches."""

import random

import numpy as np
import pytest

from lodestrand.llm import piece_codec, queries

ODD = [*"aAbzİßé0129'’.,;!<|>- \n\t▁漢字😀́", " the", " of ", "\n\n", "  ", "ción", "<s>", "<0x41>"]


@pytest.mark.parametrize("remembered", [500_000, 5])
def test_ids_and_texts_are_the_librarys(monkeypatch, remembered):
    import sentencepiece

    monkeypatch.setattr(piece_codec, "REMEMBERED", remembered)
    path, rnd = queries.tokenizer("piece_bpe_32k.model"), random.Random(4)
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.PieceCodec(path)
    rows = ["".join(rnd.choices(ODD, k=rnd.randrange(30))) for _ in range(2000)] + ["", " ", "▁", "\n", "of " * 5000]
    for i in range(0, len(rows), 256):
        some = rows[i : i + 256]
        made = [np.frombuffer(m, codec.kind).astype(np.int32) for m in codec.encode(some)]
        assert [m.tolist() for m in made] == [library.encode(t) for t in some]
        at = np.concatenate(([0], np.cumsum([len(m) for m in made])))
        assert codec.decode(np.concatenate(made), at) == [library.decode(m.tolist()) for m in made]
    assert codec.encode([]) == [] and codec.decode(np.zeros(0, np.int32), np.zeros(1, np.int64)) == []


def test_words_met_again_are_not_merged_again(monkeypatch):
    codec, merged = piece_codec.PieceCodec(queries.tokenizer("piece_bpe_32k.model")), []
    monkeypatch.setattr(codec, "merge", lambda words, merge=codec.merge: merged.extend(words) or merge(words))
    for _ in range(2):
        codec.encode(["one two one", "two three"])
    assert sorted(merged) == ["▁one", "▁three", "▁two"]
