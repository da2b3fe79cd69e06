"""Alignment against both libraries and a plain loop over tokens: odd texts, repeated rows, long texts, several passes."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import alignment

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["<|endoftext|>", "</s>", "<s>", "<0x0A>", "it's", "don't ", "é", "中文字", "😀", "\n", "\n\n", "\t", "  ", "   ", "a", "straße", "İ", "ﬁ", "1234567", "٣", "aaaaaaaaaaaaaaaa", "====", "​", "́", "Word", "www.x.org/"]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    a_model.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    made = []
    for _, text in rows:
        groups, links = [], Counter()
        if text:
            ids_a, ids_b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            bytes_a = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b_model.id_to_piece(i)[1:-1], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
                i = j = 0
                while i < len(ids_a):
                    x, y, m, n = [ids_a[i]], [ids_b[j]], len(bytes_a[i]), len(bytes_b[j])
                    while m != n:
                        if m < n:
                            i += 1
                            x.append(ids_a[i])
                            m += len(bytes_a[i])
                        else:
                            j += 1
                            y.append(ids_b[j])
                            n += len(bytes_b[j])
                    i, j = i + 1, j + 1
                    groups.append((x, y))
                    cx, cy = Counter(x), Counter(y)
                    for p, k in cx.items():
                        for q, h in cy.items():
                            links[p, q] += k * h
        made.append((groups, links))
    docs, most = Counter(k for _, links in made for k in links), defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = Counter()
    for (doc, _), (groups, links) in zip(rows, made):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[
            doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), sum(n for k, n in links.items() if docs[k] == most[k[0]]),
            sum(n * docs[k] for k, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    words = ["the", "of", "Anblewh", "sttible", "thonre", "and,", "erst.", "tion", "que", "für", "x"]
    plain = [" ".join(rnd.choices(words, k=rnd.randrange(1, 60))) for _ in range(60)]
    odd = ["".join(rnd.choices([*ODD, " ", " the", " of"], k=rnd.randrange(1, 40))) for _ in range(200)]
    special = [None, "", " ", "\n", " lead", "trail ", "▁x y", "a ▁", "\x00", "the", "=" * 700, "ab" * 900, "a" * 5000, "の" * 3000, " ".join(rnd.choices(words, k=30_000)), "".join(rnd.choices(ODD, k=8000)), ("ha" * 41 + "\n") * 200]
    texts = plain + odd + special + [plain[0]]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [out[3], out[3], out[3], (None, "the of"), (None, "the of"), (None, None), (5, "another text under the id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit("x"), "twin": F.lit(1), "at": F.lit(None).cast("int"), "n_a": F.lit(2), "ids": F.lit("y"), "copies": F.lit(3)}).repartition(6)


def got(docs):
    return Counter(tuple(r) for r in alignment.alignment(docs, PATH_A, PATH_B).collect())


def test_brute_force(docs, rows):
    assert got(docs) == brute(rows)


def test_passes_chunks_and_large_groups(docs, rows, monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS", 300)
    monkeypatch.setattr(alignment, "EVENTS", 7)
    assert got(docs) == brute(rows)


def test_links_of_large_groups(spark, rows, monkeypatch):
    """Groups above LINKS, in this process: the same rows, links and times."""
    import pyarrow as pa

    texts = spark.createDataFrame(rows, "doc long, text string").where("doc IS NOT NULL").select("doc", F.xxhash64(F.coalesce("text", F.lit(""))).alias("twin"), F.coalesce("text", F.lit("")).alias("text"))
    events = [alignment.events(texts, side, path).toArrow() for side, path in ((alignment.A, PATH_A), (alignment.B, PATH_B))]
    batches = pa.concat_tables(events).sort_by([(c, "ascending") for c in ("doc", "twin", "at", "side")]).combine_chunks().to_batches(max_chunksize=50)
    swept = lambda: [r for b in alignment._swept(PATH_A, PATH_B)(iter(batches)) for r in b.to_pylist()]
    want = swept()
    monkeypatch.setattr(alignment, "LINKS", 1)
    assert swept() == want


def test_empty(docs):
    out = alignment.alignment(docs.limit(0), PATH_A, PATH_B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert out.count() == 0
