"""What steps leave in Python workers, which outlive them."""

import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import zstandard

from lodestrand.llm import common, packing, queries, tokens


def test_tasks_that_forget_leave_no_encoder():
    def run(batches):
        tokens.encoder("bytes", queries.tokenizer("byte_bpe_50k.json"), 4).encode(["some words"])
        yield from batches

    batch = pa.record_batch([pa.array([1])], names=["x"])
    for remembers, left in ((False, 0), (True, 1), (False, 0)):
        assert list(common.tidy(run, remembers)(iter([batch]))) == [batch]
        assert tokens.encoder.cache_info().currsize == left


def test_few_rows_need_no_python_workers(spark):
    schema = "name string, n int, at long"
    for rows in ([("a", 1, 1 << 40), (None, None, -1)], []):
        made = common.few_rows(spark, rows, schema)
        assert [tuple(r) for r in made.collect()] == rows
        assert made.dtypes == [("name", "string"), ("n", "int"), ("at", "bigint")]
        assert "PythonRDD" not in made._jdf.queryExecution().toRdd().toDebugString()


def test_packing_leaves_no_encoder_in_any_worker(spark):
    def left(batches):
        yield from (pa.record_batch([pa.array([tokens.encoder.cache_info().currsize])], names=["n"]) for _ in batches)

    docs = spark.createDataFrame([(i, f"some words of {i}") for i in range(80)], "doc_id long, text string").repartition(8)
    assert packing.token_pieces(docs, queries.tokenizer("byte_bpe_50k.json")).count() == 80
    assert {r["n"] for r in spark.range(0, 8, 1, 8).mapInArrow(left, "n long").collect()} == {0}


def test_ids_go_out_a_few_megabytes_at_a_time():
    ids = np.arange(1024, dtype="<u4").tobytes()
    n = 3000
    whole = pa.record_batch([pa.array(range(n)), pa.array([1024] * n), pa.array([zstandard.compress(ids)] * n)], names=["doc_id", "length", "z"])
    out = list(packing._with_ids(iter([whole, whole.slice(0, 0)])))
    assert [x for b in out for x in b.column("doc_id").to_pylist()] == list(range(n))
    assert all(b.schema.names == ["doc_id", "length", "ids"] and set(b.column("ids").to_pylist()) == {ids} for b in out)
    assert max(sum(map(len, b.column("ids").to_pylist())) for b in out) <= 4 << 20


def test_pieces_do_not_depend_on_the_blocks(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 7)))
    path, encode, sizes = queries.tokenizer("byte_bpe_50k.json"), tokens.ByteLevel.encode, []
    monkeypatch.setattr(tokens.ByteLevel, "encode", lambda self, texts: sizes.append(sum(len(t.encode()) for t in texts)) or encode(self, texts))
    texts = [None, "", "one über two.\nThree ", *(f"some words of {i}, " * i for i in range(60))]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    made = []
    for most in (4 << 20, 3000, 1):
        monkeypatch.setattr(packing, "ENCODED_BYTES", most)
        del sizes[:]
        made.append([r for b in packing._pieces(path, 64, 2, True)(iter([batch.slice(0, 40), batch.slice(40)])) for r in b.to_pylist()])
        assert all(n <= max(most, max(len(t or "") for t in texts)) for n in sizes)
    assert made[0] == made[1] == made[2] and {r["part"] for r in made[0]} == {7}
    library = tokens.encoder("bytes", path, 4).tokenizer
    for doc, text in enumerate(texts):
        own = [r for r in made[0] if r["doc_id"] == doc]
        raw = [zstandard.decompress(r["z"]) for r in own]
        assert np.frombuffer(b"".join(raw), "<u4").tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert [zlib.crc32(x) for x in raw] == [r["ids_crc32"] for r in own] and [len(x) // 4 for x in raw] == [r["length"] for r in own]
