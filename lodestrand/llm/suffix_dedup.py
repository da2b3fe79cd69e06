"""Suffix-array dedup: bytes covered by a long string that also starts earlier go.

Suffixes are bucketed by content first, so that no task needs the whole text: each window of `length` bytes is filed
under its smallest ANCHOR-byte string (its minimizer), a function of the window's content. Neighbouring windows under
the same anchor travel as one string. A bucket's strings come in shards; each shard is in suffix order, with the
Burrows-Wheeler transform's neighbours: what follows the anchor, and, read backwards, what precedes it. The shards'
orders are merged by iterative interleave refinement, eight bytes a round: a round refines the blocks of the
interleave that are not yet told apart by one more symbol, and where neighbours part gives their common prefix. No
round sorts suffixes that are already told apart. Repeated windows are the intervals of both orders whose common
prefixes add up to `length`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, blocks, cut, mix, opened, packed, Powers, prefix_hash, ready, text_bytes, tidy, U

#: Bytes of an anchor. A window of 100 bytes has 69 of them; about one position in 35 is some window's smallest.
ANCHOR = 32
#: Occurrences of an anchor from which its bucket is dealt out to shards that are reduced on their own first.
HOT = 20_000
#: Bytes of strings that one merge holds at once; a bucket is never split between merges.
MERGE_BYTES = 8 << 20
SYMBOL = 8
#: Strings whose symbols are cut out at once.
STRINGS_AT_ONCE = 4096


def anchored_runs(data: np.ndarray, length: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows under one anchor: (first start, number of windows, anchor's place, anchor's hash).

    starts and ends bound the documents in data; windows lie within one document.
    """
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    _, down = Powers.to(n + 1)
    sums = prefix_hash(data)
    h = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
    bits = U(max(1, int(n).bit_length()))
    low = (U(1) << bits) - U(1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, span = length - ANCHOR + 1, 1
    while 2 * span <= width:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    at = (m & low).astype(np.int64)  # at[p]: the anchor of the window that starts at p
    inside = np.zeros(n + 1, np.int32)
    long_enough = ends - starts >= length
    np.add.at(inside, starts[long_enough], 1)
    np.add.at(inside, ends[long_enough] - length + 1, -1)
    inside = np.cumsum(inside[: len(at)]) > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
    document = np.zeros(len(at), bool)
    document[starts[starts < len(at)]] = True
    new |= inside & document
    first = np.flatnonzero(new)
    stop = new | ~inside
    after = np.append(np.flatnonzero(stop), len(at))
    count = after[np.searchsorted(after, first, "right")] - first
    return first, count, at[first], h[at[first]]


ANCHORS = "anchor long, key long, run long"


def pack(start: np.ndarray, count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A run in one long: its start, the number of its windows, and the anchor's place in it."""
    return (start << 20) | (count << 10) | offset


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            key = batch.column("key").to_numpy()
            for i, j in blocks(at, BLOCK_BYTES):
                bounds = at[i : j + 1] - at[i]
                first, count, place, h = anchored_runs(data[at[i] : at[j]], length, bounds[:-1], bounds[1:])
                row = np.searchsorted(bounds, first, "right") - 1
                # of empty documents at one place, the last bound holds the windows
                run_ = pack(first - bounds[row], count, place - first)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(key[i + row]), pa.array(run_)], names=["anchor", "key", "run"])

    return run


def hashes_at(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The hashes of the ANCHOR bytes at each place."""
    h = np.zeros(len(place), np.uint64)
    up, _ = Powers.to(ANCHOR)
    for k in range(ANCHOR):
        h += (data[place + k].astype(np.uint64) + U(1)) * up[k]
    return mix(h)


STRINGS = "anchor long, doc long, twin long, run long, shard long, bytes binary"
#: Strings that are packed, or unpacked, at once.
PACKED_AT_ONCE = 100_000
#: Blocks of strings for each partition of the shuffle: more make its partitions more even, and blocks smaller.
BLOCKS = 4


def flat_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), at


def _strings(length: int, targets: int):
    """Cuts the runs that repeat out of their documents' texts; strings of one target go into one compressed block.

    A bucket's strings have one target each (by anchor and shard), so blocks need no further key. A block is doc, twin,
    run and shard of its strings, then their bytes; lengths and anchors follow from the run and the bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch, texts in opened(batches):
            data, at = text_bytes(texts)
            runs = batch.column("runs")
            flat = runs.flatten()
            of = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
            run_, shard = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            doc, twin = (batch.column(k).to_numpy(zero_copy_only=False)[of] for k in ("doc", "twin"))
            begin = at[of] + (run_ >> 20)
            size = ((run_ >> 10) & 1023) + length - 1
            target = (mix(hashes_at(data, begin + (run_ & 1023)) ^ mix(shard.astype(np.uint64))) % U(targets)).astype(np.int64)
            for a in range(0, len(of), PACKED_AT_ONCE):
                order = a + np.argsort(target[a : a + PACKED_AT_ONCE], kind="stable")
                edge = np.flatnonzero(np.diff(target[order])) + 1
                names, n, z = [], [], []
                for block in np.split(order, edge):
                    ends = np.cumsum(size[block])
                    index = np.arange(ends[-1]) + np.repeat(begin[block] - ends + size[block], size[block])
                    numbers = np.concatenate((doc[block], twin[block], run_[block], shard[block])).astype("<i8")
                    names.append(int(target[block[0]]))
                    n.append(len(block))
                    z.append(compress(numbers.tobytes() + data[index].tobytes()))
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array(n, pa.int64()), pa.array(z, pa.binary())], names=["target", "n", "z"])

    return run


def _from_blocks(length: int):
    """The strings of blocks, as rows of STRINGS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            count = batch.column("n").to_numpy()
            for i, j in blocks(np.concatenate(([0], np.cumsum(count))), PACKED_AT_ONCE):
                numbers, texts = [], []
                for n, z in zip(count[i:j], batch.column("z").slice(i, j - i).to_pylist(), strict=True):
                    raw = unpack(z)
                    numbers.append(np.frombuffer(raw, "<i8", 4 * n).reshape(4, n))
                    texts.append(np.frombuffer(raw, np.uint8)[32 * n :])
                doc, twin, run_, shard = np.concatenate(numbers, axis=1)
                data = np.concatenate(texts)
                size = ((run_ >> 10) & 1023) + length - 1
                at = np.concatenate(([0], np.cumsum(size)))
                anchor = hashes_at(data, at[:-1] + (run_ & 1023)).view(np.int64)
                text = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
                yield pa.record_batch([*map(pa.array, (anchor, doc, twin, run_, shard)), text], names=["anchor", "doc", "twin", "run", "shard", "bytes"])

    return run


def columns_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, step: int, width: int) -> np.ndarray:
    """Symbols of SYMBOL bytes (big-endian) of the strings that start at `start` and go by step (1, or -1: backwards)."""
    symbols = -(-width // SYMBOL)
    place = np.arange(symbols * SYMBOL)
    out = np.empty((len(start), symbols), np.uint64)
    for a in range(0, len(start), STRINGS_AT_ONCE):  # the places take eight times the bytes
        index = start[a : a + STRINGS_AT_ONCE, None] + step * place
        raw = data[np.clip(index, 0, len(data) - 1)]
        raw[place >= size[a : a + STRINGS_AT_ONCE, None]] = 0
        out[a : a + len(raw)] = raw.view(">u8")
    return out


def shard_order(group: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """A shard's suffix order: by bucket, then content."""
    return np.lexsort((*symbols.T[::-1], group))


def merged(orders: list[np.ndarray], group: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of sorted shards, and the common prefix of each entry with the one before it, in bytes.

    Round h has the interleave in order of bucket and h symbols. Only blocks of entries that agree so far are refined;
    within a block each shard's entries are in order, so a stable sort by the next symbol merges their runs.
    """
    z = np.concatenate(orders)
    z = z[np.argsort(group[z], kind="stable")]
    g = group[z]
    n, rounds = len(z), symbols.shape[1]
    common = np.full(n, rounds * SYMBOL, np.int32)
    head = np.concatenate(([True], g[1:] != g[:-1])) if n else np.zeros(0, bool)
    common[head] = 0
    for h in range(rounds):
        alone = head & np.append(head[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        block = np.cumsum(head[at])
        value = symbols[z[at], h]
        order = np.lexsort((value, block))
        z[at] = z[at][order]
        value = value[order]
        new = np.concatenate(([True], (value[1:] != value[:-1]) & (block[1:] == block[:-1])))
        new[0] = False
        apart = value[1:][new[1:]] ^ value[:-1][new[1:]]
        same = (apart.astype(">u8").view(np.uint8).reshape(-1, SYMBOL) != 0).argmax(1)
        common[at[new]] = h * SYMBOL + same
        head[at[new]] = True
    return z, common


def repeated_windows(data: np.ndarray, first: np.ndarray, count: np.ndarray, offset: np.ndarray, group: np.ndarray, rank: np.ndarray, shard: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows (string, place) that equal a window of a smaller rank, or a smaller place under the same rank.

    String i has count[i] windows, starts at first[i] in data, and has its anchor offset[i] bytes on. rank is dense and
    orders (document, start of the string); strings of one rank are one string (a repeated row).
    """
    n = len(first)
    size = count + length - 1
    anchor = first + offset
    forward = columns_of(data, anchor, size - offset, 1, int((size - offset).max()))
    back = columns_of(data, anchor - 1, offset, -1, max(1, int(offset.max())))
    runs, places = [], []
    for symbols in (forward, back):
        orders = [s[shard_order(group[s], symbols[s])] for s in (np.flatnonzero(shard == k) for k in np.unique(shard))]
        z, common = merged(orders, group, symbols)
        place = np.empty(n, np.int64)
        place[z] = np.arange(n)
        runs.append(common)
        places.append(place)
    found_string, found_place = [], []
    for left in range(int(offset.max()) + 1):
        place = offset - left  # of the window that begins `left` bytes before the anchor
        live = np.flatnonzero((place >= 0) & (place < count))
        if len(live) < 2:
            continue
        right_class = np.cumsum(runs[0] < length - left)[places[0][live]]
        left_class = np.cumsum(runs[1] < left)[places[1][live]] if left else np.zeros(len(live), np.int64)
        # a right class lies within one bucket, and only bytes that both windows have count: shorter strings are padded
        key = right_class * (n + 1) + left_class
        order = np.argsort(key, kind="stable")
        k, r = key[order], rank[live][order]
        head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        least = np.repeat(np.minimum.reduceat(r, head), np.diff(np.append(head, len(r))))
        later = order[r > least]
        found_string.append(live[later])
        found_place.append(place[live[later]])
    if not found_string:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_string), np.concatenate(found_place)


FOUND = "doc long, twin long, start long, size long, anchor long, run long, bytes binary"


def _reduce(length: int):
    """Repeated stretches (start, size) in whole buckets; of buckets that are shards (shard > 0) also the strings with other windows."""

    def one(table: pa.Table) -> pa.RecordBatch:
        data, at = flat_bytes(table.column("bytes"))
        anchor, doc, twin, run, shard = (table.column(k).to_numpy() for k in ("anchor", "doc", "twin", "run", "shard"))
        begin = run >> 20
        key = np.lexsort((begin, twin, doc))
        moved = np.concatenate(([True], (np.diff(doc[key]) != 0) | (np.diff(twin[key]) != 0) | (np.diff(begin[key]) != 0)))
        rank = np.empty(len(key), np.int64)
        rank[key] = np.cumsum(moved)
        group = np.cumsum(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (shard[1:] != shard[:-1]))))
        count, offset = (run >> 10) & 1023, run & 1023
        string, place = repeated_windows(data, at[:-1], count, offset, group, rank, rank * 4 // (len(rank) + 1), length)
        order = np.lexsort((place, string))
        string, place = string[order], place[order]
        new = np.concatenate(([True], (np.diff(string) != 0) | (np.diff(place) != 1))) if len(string) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        of = string[head]
        size = np.diff(np.append(head, len(string))) + length - 1
        left = np.flatnonzero((np.bincount(string, minlength=len(run)) < count) & (shard > 0))
        spans = {"doc": doc[of], "twin": twin[of], "start": begin[of] + place[head], "size": size}
        rest = {"doc": doc[left], "twin": twin[left], "anchor": anchor[left], "run": run[left]}
        parts = [pa.concat_arrays([pa.array(x[k], pa.int64()) if k in x else pa.nulls(m, pa.int64()) for x, m in ((spans, len(of)), (rest, len(left)))]) for k in ("doc", "twin", "start", "size", "anchor", "run")]
        strings = pa.concat_arrays([pa.nulls(len(of), pa.binary()), table.column("bytes").combine_chunks().take(pa.array(left, pa.int64()))])
        return pa.record_batch([*parts, strings], names=["doc", "twin", "start", "size", "anchor", "run", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size > MERGE_BYTES:  # all but the last bucket, which may go on
                whole = pa.concat_tables(held).combine_chunks()
                anchor, shard = whole.column("anchor").to_numpy(), whole.column("shard").to_numpy()
                edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (shard[1:] != shard[:-1]))
                if len(edge):
                    at = int(edge[-1]) + 1
                    yield one(whole.slice(0, at))
                    whole = pa.concat_tables([whole.slice(at)])
                held, size = [whole], sum(map(len, [whole])) * 200
        if held and (whole := pa.concat_tables(held).combine_chunks()).num_rows:
            yield one(whole)

    return run


def _in_buckets(strings: DataFrame, length: int) -> DataFrame:
    """Reduces strings whose buckets lie within partitions."""
    return strings.sortWithinPartitions("anchor", "shard").mapInArrow(tidy(_reduce(length)), FOUND)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, twin, text, row, own): a document's place in the order (a null doc_id comes first; rows of one doc_id go by a hash of their text), and its row, its text apart (own) and as it was."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("twin"), text.alias("text"), F.struct(*(F.lit(None).cast("string").alias("text") if c == "text" else F.col(c) for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("own"))


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc, twin, start, size): stretches of bytes of keyed docs that strings of `length` bytes cover that also start earlier.

    Whole copies of an earlier document are one stretch and take no further part. Two documents that are one row twice
    count as one.
    """
    docs = docs.where(F.octet_length("text") >= length).select("doc", "twin", "text")
    same = docs.select("doc", "twin", F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("size"))
    copied = same.groupBy("twin", "md5", "size").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    copies = cut(same.join(copied, ["twin", "md5", "size"]).where("doc > least").select("doc", "twin", "size").distinct())
    # one 64-bit key for (doc, twin) until the strings are cut out
    key = F.xxhash64("doc", "twin").alias("key")
    anchors = docs.select(key, "text").mapInArrow(tidy(_anchors(length)), ANCHORS)
    runs = anchors.withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).where("n > 1")
    # a hot bucket's strings are reduced in shards of about HOT first; what is left of them meets afterwards
    shard = F.when(F.col("n") > HOT, 1 + F.pmod(F.hash("key").cast("long"), F.ceil(F.col("n") / HOT))).otherwise(F.lit(0).cast("long"))
    runs = runs.groupBy("key").agg(F.collect_set(F.struct("run", shard.alias("shard"))).alias("runs")).join(copies.select(key), "key", "left_anti")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = packed(docs.select(key, "doc", "twin", "text")).join(runs, "key").select("doc", "twin", "z", "runs").mapInArrow(tidy(_strings(length, BLOCKS * parts)), "target long, n long, z binary")
    first = cut(_in_buckets(told.repartition(parts, "target").mapInArrow(tidy(_from_blocks(length)), STRINGS), length))
    rest = first.where("start IS NULL").select("anchor", F.lit(0).cast("long").alias("shard"), "doc", "twin", "run", "bytes")
    second = _in_buckets(rest.repartition("anchor"), length)
    columns = ("doc", "twin", "start", "size")
    return first.where("start IS NOT NULL").select(*columns).union(second.select(*columns)).union(copies.select("doc", "twin", F.lit(0).cast("long"), "size"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in opened(batches):
        data, at = text_bytes(texts)
        total, runs, kept = [], [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            text = data[at[i] : at[i + 1]]
            gone = 0
            if spans:
                edge = np.zeros(len(text) + 1, np.int32)
                place = np.array([(s["start"], s["start"] + s["size"]) for s in spans])
                np.add.at(edge, place[:, 0], 1)
                np.add.at(edge, place[:, 1], -1)
                out = np.cumsum(edge)[:-1] > 0
                gone = int((out & ~np.concatenate(([False], out[:-1]))).sum())
                text = text[~out]
            total.append(int(at[i + 1] - at[i]))
            runs.append(gone)
            kept.append(text.tobytes())
        left = pa.array(kept, pa.binary())
        size = np.array(total, np.int64)
        lost = size - np.array([len(k) for k in kept], np.int64)
        row = batch.column("row")
        names = [f.name for f in row.type]
        row = pa.StructArray.from_arrays([texts if k == "text" else row.field(i) for i, k in enumerate(names)], names)
        yield pa.record_batch([row, pa.array(size), pa.array(lost), pa.array(runs, pa.int64()), left], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): row (its columns), n_bytes, n_removed, n_spans, kept (the bytes left).

    A byte goes if a string of `length` bytes covers it, within one document, that also starts earlier: in a smaller
    doc_id or further left. Strings are judged on the input. A null text is empty; texts under `length` bytes, empty
    tables and unrepeated texts stay as they are. A null doc_id comes before all others. Documents of one doc_id with
    different texts are ordered by a hash of the text; equal rows count as one document and have equal results. All
    columns of docs travel in `row`, so none can clash. kept may end within a character; see `readable`.
    """
    ready(docs.sparkSession)
    rows = keyed(docs)
    marks = cut(repeated_spans(rows, length)).groupBy("doc", "twin").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    schema = T.StructType([rows.schema["row"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    own = packed(rows.select("doc", "twin", "row", "own"), "own")
    return own.join(marks, ["doc", "twin"], "left").select("row", "z", "spans").mapInArrow(tidy(_removed), schema)


def _readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = batch.column("row")
        names = [f.name for f in row.type]
        text = pa.array([k.decode("utf-8", "ignore") for k in batch.column("kept").to_pylist()], pa.string())
        was = row.field(names.index("text"))
        text = pa.compute.if_else(was.is_null(), pa.nulls(len(text), pa.string()), text)
        yield pa.record_batch([text if k == "text" else pa.compute.utf8_length(text).cast(pa.int64()) if k == "n_chars" else row.field(i) for i, k in enumerate(names)], names=names)


def readable(removed: DataFrame) -> DataFrame:
    """The documents' own columns with what is left as text (n_chars, if there, follows); of a character that a removal cut, the rest goes too."""
    schema = removed.schema["row"].dataType
    return removed.select("row", "kept").mapInArrow(tidy(_readable), schema)
