"""Shuffled windows of sequences that keep the counts of letters, or of pairs of neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship


def pair_preserving(text: str, random: Random) -> str:
    """A random text with the same first and last letter and the same count of every pair of neighbours.

    Neighbours are edges of a graph of letters, and a text is a path over all of them. Random walks draw for each letter
    but the text's last one the edge that is taken last, so that these lead every letter to the text's end; the other
    edges are shuffled, and the path takes them in turn.
    """
    if len(text) < 4:
        return text
    out: dict[str, list[str]] = {}
    for a, b in zip(text, text[1:]):
        out.setdefault(a, []).append(b)
    end = text[-1]
    last, leads = {}, {end}
    for start in out:
        a = start
        while a not in leads:  # a walk whose loops are forgotten, as the choice at a letter is drawn anew
            last[a] = random.randrange(len(out[a]))
            a = out[a][last[a]]
        a = start
        while a not in leads:
            leads.add(a)
            a = out[a][last[a]]
    turns = {}
    for a, all_ in out.items():
        rest = [b for k, b in enumerate(all_) if k != last.get(a)]
        random.shuffle(rest)
        turns[a] = iter([*rest, all_[last[a]]] if a in last else rest)
    path, at = [text[0]], text[0]
    for _ in range(len(text) - 1):
        at = next(turns[at])
        path.append(at)
    return "".join(path)


def letters_preserving(text: str, random: Random) -> str:
    return "".join(random.sample(text, len(text)))


def window_shuffles(df: DataFrame, key: str, seq: str, window: int, samples: int = 1, pairs: bool = True, seed: int = 42) -> DataFrame:
    """(key, start, sample, shuffled): each window [start, start + window) of each sequence, shuffled `samples` times.

    pairs: the counts of neighbouring letters are kept, else those of letters. A shuffle depends on the seed, the key, the
    start and the sample only, so it can be made again. The last window may be shorter; null sequences have none.
    """
    ship(df.sparkSession)
    shuffle = pair_preserving if pairs else letters_preserving

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for start in range(0, len(text or ""), window):
                    for k in range(samples):
                        own = hashlib.blake2b(f"{seed}:{name}:{start}:{k}".encode(), digest_size=8).digest()
                        rows.append((name, start, k, shuffle(text[start : start + window], Random(own))))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string()))], names=[key, "start", "sample", "shuffled"])

    schema = T.StructType([df.schema[key], T.StructField("start", T.LongType()), T.StructField("sample", T.LongType()), T.StructField("shuffled", T.StringType())])
    return df.select(key, seq).mapInArrow(run, schema)
