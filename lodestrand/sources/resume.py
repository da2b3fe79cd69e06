"""Parts of a table written once each: a marker says with which content, and a second run does only what is missing."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .store import place
from .tfrecord import RECORDS, example, framed


def marker(label: str, part: int) -> str:
    return f"success-{label}-part-{part}.json"


def markers(path: str, label: str) -> dict[int, dict]:
    """What the markers of finished parts say; one that can't be read counts as missing."""
    system, at = place(path)
    out = {}
    if system.get_file_info(at).type == fs.FileType.Directory:
        for f in system.get_file_info(fs.FileSelector(at)):
            if f.base_name.startswith(f"success-{label}-part-") and f.base_name.endswith(".json"):
                try:
                    said = json.loads(system.open_input_stream(f.path).read())
                    out[said["part"]] = said
                except (ValueError, KeyError):
                    continue
    return out


def fingerprints(df: DataFrame, part: Column) -> dict[int, tuple[int, str]]:
    """(rows, sum of row hashes) of each part; partial sums, so only a row for each part and task is shuffled."""
    hashes = F.sum(F.xxhash64(*(F.to_json(c) if t.startswith(("map", "struct")) else F.col(c) for c, t in df.dtypes)).cast("decimal(38,0)"))
    rows = df.groupBy(part.cast("long").alias("part")).agg(F.count("*").alias("n"), hashes.cast("string").alias("hash"))
    return {r["part"]: (r["n"], r["hash"]) for r in rows.collect()}


def _written(path: str, label: str, columns: list[str], told: dict[int, tuple[int, str]]):
    """Writes each part's records, then moves its files in place and marks it; rows come part by part."""

    def finish(part: int, held: list[bytes]) -> tuple[int, int, int]:
        import zlib

        system, at = place(path)
        attempt = TaskContext.get().taskAttemptId()
        names = [f"{label}-part-{part}-{k}.tfr" for k in range(-(-len(held) // RECORDS))]
        for k, name in enumerate(names):
            with system.open_output_stream(f"{at}/_{attempt}-{name}") as out:
                out.write(zlib.compress(b"".join(held[k * RECORDS : (k + 1) * RECORDS])))
        for f in system.get_file_info(fs.FileSelector(at)):  # of an earlier content
            if f.base_name.startswith(f"{label}-part-{part}-") and f.base_name not in names:
                system.delete_file(f.path)
        for name in names:
            system.move(f"{at}/_{attempt}-{name}", f"{at}/{name}")
        with system.open_output_stream(f"{at}/{marker(label, part)}") as out:
            out.write(json.dumps({"part": part, "rows": len(held), "fingerprint": list(told[part]), "files": names}).encode())
        return part, len(held), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            parts = batch.column("__part").to_pylist()
            for part, row in zip(parts, batch.select(columns).to_pylist()):
                if part != now:
                    if now is not None:
                        yield pa.record_batch([pa.array([x], pa.int64()) for x in finish(now, held)], names=["part", "rows", "files"])
                    now, held = part, []
                held.append(framed(example(row)))
        if now is not None:
            yield pa.record_batch([pa.array([x], pa.int64()) for x in finish(now, held)], names=["part", "rows", "files"])

    return run


def write_parts(df: DataFrame, part: Column, path: str, label: str = "train", order: tuple[str, ...] = ()) -> list[tuple[int, int, int]]:
    """Writes the parts of df (an integer column says which) as TFRecords, and returns (part, rows, files) of those it wrote.

    A part whose marker names its content (rows and sum of row hashes) is left alone, so a run after a failure goes on with
    the parts that failed, and one after a change writes those that changed. A part is one task's and is held there
    compressed as records, so parts are chosen of bounded size; a part is marked after its files are in place, and a
    task that runs twice writes the same names.
    """
    ship(df.sparkSession)
    system, at = place(path)
    system.create_dir(at, recursive=True)
    now, done = fingerprints(df, part), markers(path, label)
    todo = {p: f for p, f in now.items() if p is not None and list(f) != done.get(p, {}).get("fingerprint")}
    if not todo:
        return []
    rows = df.withColumn("__part", part.cast("long")).where(F.col("__part").isin(list(todo)))
    rows = rows.repartition(len(todo), "__part").sortWithinPartitions("__part", *order)
    return sorted((r["part"], r["rows"], r["files"]) for r in rows.mapInArrow(_written(path, label, df.columns, todo), "part long, rows long, files long").collect())
