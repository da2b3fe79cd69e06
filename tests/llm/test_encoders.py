"""The encoders that remember words against the whole tokenizers library, on odd texts and every Latin letter."""

import gc
import random
import weakref
from array import array

import pytest

from lodestrand.llm import queries, tokens

ODD = [*"aAbzİIıßÉéǅǄµªº²½٣0129'’s.,;!<|>-_ \n\t\u0331\u0301HhKςΣжЖ漢字ﬁ😀", "'s", "'LL", " don't ", "<|endoftext|>", "it's,", "***", "Éa.", "Ab12,", "x²."]


def texts():
    rnd = random.Random(2)
    odd = ["".join(rnd.choices(ODD, k=rnd.randrange(40))) for _ in range(5000)]
    latin = [chr(c) + after for c in range(0x250) for after in ("", ".", "a,", " b", "'s")]
    return odd + latin + ["a" + chr(c) + "." for c in range(0x250)] + ["", "word,*** " * 3000]


@pytest.mark.parametrize("cls,name,width", [(tokens.WordLevel, "word_bpe_49k.json", 2), (tokens.ByteLevel, "byte_bpe_50k.json", 4)])
@pytest.mark.parametrize("remembered", [500_000, 50])
def test_ids_are_the_librarys(monkeypatch, cls, name, width, remembered):
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    encoder, rows = cls(queries.tokenizer(name), width), texts()
    for i in range(0, len(rows), 256):
        some = rows[i : i + 256]
        want = [array(encoder.kind, e.ids).tobytes() for e in encoder.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        assert encoder.encode(some) == want


def test_words_are_made_once_and_go_with_their_encoder(monkeypatch):
    """Each distinct word is made when it is first looked up, and nothing holds an encoder that was let go."""
    made, ids = [], tokens.ByteLevel.ids
    monkeypatch.setattr(tokens.ByteLevel, "ids", lambda self, word: made.append(word) or ids(self, word))
    encoder = tokens.ByteLevel(queries.tokenizer("byte_bpe_50k.json"), 4)
    for _ in range(2):
        encoder.encode(["first one two. one", "other two. three one"])
    assert made == [" one", " two.", " three"]
    gone = weakref.ref(encoder)
    gc.disable()
    try:
        del encoder
        assert gone() is None
    finally:
        gc.enable()


def test_line_ends_and_mixed_words_go_straight_to_the_merges(monkeypatch):
    """Words with a line's end or digits inside, most of which are new, need no call of the whole library."""
    encoder = tokens.ByteLevel(queries.tokenizer("byte_bpe_50k.json"), 4)
    rows = ["a of.\nHere we'll go\n\nx it's.\n'Tis a1b22.c@d.example", "a ç.\nÉai b\n c \nd e\r\nf g\n\x1ch <|endoftext|>\nk", "x " + "\n".join(["l'été,", "'s", "--'re"]) + " y", "x á.\nb c\xa0\nd é\x85\nf"]
    want = [array("I", e.ids).tobytes() for e in encoder.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]
    assert encoder.encode(rows) == want
    encoder.known.clear()
    encoder.parts.clear()
    monkeypatch.setattr(encoder, "tokenizer", None)
    assert encoder.ids(" a1b22.c@d.example") and encoder.made("of.\nHere") and encoder.made("ç.\nÉai,\nx")
