"""TFRecord files by the thousand, and checksums of many records together."""

import random

import pytest

from lodestrand.sources import tfrecord


def plain(data):
    s = 0xFFFFFFFF
    for x in data:
        s ^= x
        for _ in range(8):
            s = s >> 1 ^ (0x82F63B78 if s & 1 else 0)
    return s ^ 0xFFFFFFFF


def test_checksums_together():
    rnd = random.Random(6)
    all_ = [rnd.randbytes(n) for n in (0, 1, 3, 4, 31, 32, 33, 255, 256, 257, 511, 512, 5000, 8)] + [bytes(600), b"\xff" * 300]
    assert plain(b"123456789") == 0xE3069283
    assert tfrecord.checksums(all_) == [plain(x) for x in all_] and [tfrecord.crc32c(x) for x in all_] == [plain(x) for x in all_]


def test_damaged_record_of_many(monkeypatch):
    monkeypatch.setattr(tfrecord, "AT_ONCE", 3)
    made = [bytes([i]) * (40 + i) for i in range(8)]
    whole = [tfrecord.framed(x) for x in made]
    assert list(tfrecord.records(iter([b"".join(whole)]), "f")) == made
    assert list(tfrecord.records((bytes([x]) for x in b"".join(whole)), "f")) == made
    for bad, named in ((whole[4][:-9] + b"!" + whole[4][-8:], "record 4 is"), (whole[4][:20], "record 4 is"), (b"x" + whole[4][1:], "head of record 4")):
        read = tfrecord.records(iter([b"".join([*whole[:4], bad])]), "f")
        assert [next(read) for _ in range(4)] == made[:4]
        with pytest.raises(ValueError, match=named):
            next(read)


def test_many_files_are_few_partitions(spark, tmp_path):
    path = str(tmp_path / "many")
    tfrecord.write_tfrecords(spark.range(0, 3000, 1, 3).selectExpr("id", "repeat('x', 50) AS s"), path, count=2)
    read = tfrecord.read_tfrecords(spark, path, "id long, s string")
    assert len(list((tmp_path / "many").glob("*.tfr"))) == 1500
    assert 32 <= read.rdd.getNumPartitions() <= 160
    assert sorted(r["id"] for r in read.collect()) == list(range(3000))
