"""Repeated passages: count-min prefilter, then exact groups of what it leaves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import (
    PLAIN,
    WordHasher,
    mix,
    parts_for,
    slices,
    text_buffer,
    total_bytes,
    without,
    word_spans,
)

#: Consecutive words that make a passage.
WINDOW = 35
RESULT = ("n_words", "n_removed", "kept_text")
#: Rows of the sketch. Each has a cell for two bytes of text, up to a bound; a merged sketch
#: is broadcast as a bit per cell, 128 MB at most.
DEPTH, BYTES_PER_CELL, MOST_CELLS = 2, 2, 1 << 29
#: Parts of a row of the sketch that are merged on their own. Their number is fixed, so that
#: what a task sends grows with its windows and not with the sketch.
CHUNKS = 512
#: Windows that a task counts before it sends its sketch, and candidates that it holds before it
#: hands them on; both bound its memory.
COUNTED, FLUSH = 1 << 22, 1 << 20
#: Entries that one bucket of candidates is meant to have, and bytes of text of one group of documents.
BUCKET, GROUP = 1 << 19, 8 << 20

_SLICE = 1 << 21


# --- windows ------------------------------------------------------------------


def windows(column: pa.Array, hashers: list[WordHasher], width: int) -> Iterator[tuple]:
    """Per slice of documents: hashes of all windows (one array per hasher), document and first word."""
    data, starts = text_buffer(column)
    for a, z in slices(starts, _SLICE):
        cut = starts[a : z + 1]
        mapped, begin, end, counts = word_spans(data[cut[0] : cut[-1]], cut - cut[0], PLAIN)
        if len(begin) < width:
            continue
        doc = np.repeat(np.arange(z - a), counts)
        n = len(doc) - width + 1
        whole = np.flatnonzero(doc[:n] == doc[width - 1 :])
        first = np.cumsum(counts) - counts
        doc = doc[whole]
        yield [h.runs(h.words(mapped, begin, end), width)[whole] for h in hashers], doc + a, whole - first[doc]


def cells(hashes: np.ndarray, row: int, size: int) -> np.ndarray:
    """Cell of each window in a row of the sketch, which has CHUNKS times ``size`` cells; numbered through all rows."""
    own = mix(hashes + np.uint64(0x9E3779B97F4A7C15 * row % 2**64)) >> np.uint64(32)
    own *= np.uint64(CHUNKS * size)
    own >>= np.uint64(32)
    own += np.uint64(row * CHUNKS * size)
    return own.astype(np.uint32)


# --- sketch -------------------------------------------------------------------


def packed(ordered: np.ndarray, size: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks with cells, the gaps between these as numbers of ``kind``, and where each chunk's gaps end.

    The largest number stands for a part of a gap that goes on.
    """
    most = np.iinfo(kind).max
    chunk = ordered // np.uint32(size)
    firsts = np.flatnonzero(np.diff(chunk, prepend=chunk[0] + np.uint32(1)))
    gap = np.diff(ordered, prepend=np.uint32(0))
    gap[firsts] = ordered[firsts] % np.uint32(size)
    more = gap // np.uint32(most)
    last = np.cumsum(more, dtype=np.int64) + np.arange(len(gap))
    out = np.full(int(last[-1]) + 1, most, kind)
    out[last] = gap % np.uint32(most)
    ends = np.append(last[firsts[1:] - 1] + 1, len(out))
    return chunk[firsts], out, ends


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(data, kind)
    return np.cumsum(raw, dtype=np.int64)[raw < np.iinfo(kind).max]


def _partial_rows(hashes: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """The sketch of some windows: per chunk the cells counted once and those counted more often."""
    for row in range(DEPTH):
        ordered = cells(hashes, row, size)
        ordered.sort()
        new = np.ones(len(ordered) + 1, bool)
        new[1:-1] = ordered[1:] != ordered[:-1]
        firsts = np.flatnonzero(new)
        values, often = ordered[firsts[:-1]], np.diff(firsts) > 1
        for twice in (False, True):
            chosen = values[often == twice]
            if not len(chosen):
                continue
            wide = len(chosen) * 128 < CHUNKS * size
            kind = np.uint16 if wide else np.uint8
            chunk, data, ends = packed(chosen, size, kind)
            cuts = (np.concatenate(([0], ends)) * data.itemsize).astype(np.int32)
            lists = pa.Array.from_buffers(
                pa.binary(), len(chunk), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())]
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk.astype(np.int32)), pa.array(np.full(len(chunk), twice)), pa.array(np.full(len(chunk), wide)), lists],
                ["chunk", "twice", "wide", "cells"],
            )


def sketch(texts: DataFrame, size: int, width: int, parts: int) -> np.ndarray:
    """A bit per cell of the merged sketch: whether its count is two or more.

    Each task sends the sketch of its windows chunk by chunk; chunks are added up
    where they meet, one at a time, with counts that stop at two. What comes to the
    driver has a bound that does not depend on the data.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, amount = WordHasher(0), [], 0
        for batch in batches:
            for (hashes,), _, _ in windows(batch.column(0), [hasher], width):
                held.append(hashes)
                amount += len(hashes)
                if amount >= COUNTED:
                    yield from _partial_rows(np.concatenate(held), size)
                    held, amount = [], 0
        if amount:
            yield from _partial_rows(np.concatenate(held), size)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts = None, np.zeros(size, np.uint8)

        def closed() -> pa.RecordBatch:
            bitmap = np.packbits(counts > 1).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([bitmap])], ["chunk", "bits"])

        for batch in batches:
            for chunk, twice, wide, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if chunk != current:
                    if current is not None and (counts > 1).any():
                        yield closed()
                    current = chunk
                    counts[:] = 0
                at = unpacked(data, np.uint16 if wide else np.uint8)
                counts[at] = np.minimum(counts[at] + (2 if twice else 1), 2)
        if current is not None and (counts > 1).any():
            yield closed()

    partials = texts.mapInArrow(partial, "chunk int, twice boolean, wide boolean, cells binary")
    merged = partials.repartition(parts, "chunk").sortWithinPartitions("chunk")
    out = np.zeros(DEPTH * CHUNKS * size >> 3, np.uint8)
    step = size >> 3
    for row in merged.mapInArrow(merge, "chunk int, bits binary").toLocalIterator(prefetchPartitions=True):
        out[row["chunk"] * step : (row["chunk"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
    return out


def estimated_twice(bitmap: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """Whether the sketch's count of each window is two or more; never false for a repeated one."""
    out = None
    for row in range(DEPTH):
        at = cells(hashes, row, size)
        hit = (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        out = hit if out is None else out & hit
    return out.astype(bool)


# --- candidates ----------------------------------------------------------------


def _bytes_of(*arrays: np.ndarray) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def _places(keys: np.ndarray, doc: np.ndarray, first: np.ndarray) -> bytes:
    """Documents' keys and, for each window, which of them and at which word."""
    own, inverse = np.unique(doc, return_inverse=True)
    wide = len(first) and int(first.max()) >= 1 << 16
    head = np.array([len(own), len(doc), int(wide)], np.int32)
    small = np.uint16 if len(own) < 1 << 16 else np.uint32
    return _bytes_of(head, keys[own], inverse.astype(small), first.astype(np.uint32 if wide else np.uint16))


def _read_places(data: memoryview) -> tuple[np.ndarray, np.ndarray]:
    docs, n, wide = np.frombuffer(data, np.int32, 3).tolist()
    kind = np.uint16 if docs < 1 << 16 else np.uint32
    keys = _read_keys(data)
    doc = np.frombuffer(data, kind, n, 12 + 8 * docs)
    first = np.frombuffer(data, np.uint32 if wide else np.uint16, n, 12 + 8 * docs + n * doc.itemsize)
    return keys[doc], first.astype(np.uint32)


def _read_keys(data: bytes | memoryview) -> np.ndarray:
    """Keys of the documents that have places here."""
    return np.frombuffer(data, np.int64, int(np.frombuffer(data, np.int32, 1)[0]), 12)


def _group(keys: np.ndarray, groups: int) -> np.ndarray:
    return (keys.astype(np.uint64) % np.uint64(groups)).astype(np.int64)


def _verdicts(keys: np.ndarray, first: np.ndarray, groups: int) -> Iterator[tuple[int, int, bytes]]:
    """Repeated windows by group of documents."""
    if not len(keys):
        return
    group = _group(keys, groups)
    order = np.lexsort((first, keys, group))
    group, keys, first = group[order], keys[order], first[order]
    cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own, doc = np.unique(keys[a:z], return_inverse=True)
        yield 1, int(group[a]), _places(own, doc, first[a:z])


def _candidates(
    one: np.ndarray, two: np.ndarray, keys: np.ndarray, doc: np.ndarray, first: np.ndarray, buckets: int, groups: int
) -> Iterator[tuple[int, int, bytes]]:
    """Windows estimated repeated: one entry per distinct window for its bucket.

    A window that occurs several times here is known to be repeated: its entry has no
    place, and its places are handed on right away. So no window sends more than an
    entry from here, however common it is.
    """
    order = np.argsort(one, kind="stable")
    one, two, doc, first = one[order], two[order], doc[order], first[order]
    new = np.ones(len(one) + 1, bool)
    new[1:-1] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    firsts = np.flatnonzero(new)
    often = np.diff(firsts) > 1
    repeated = np.repeat(often, np.diff(firsts))
    yield from _verdicts(keys[doc[repeated]], first[repeated], groups)
    firsts = firsts[:-1]
    bucket = ((one[firsts] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    short = (two >> np.uint64(32)).astype(np.uint32)
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own, many = firsts[a:z], often[a:z]
        once, more = own[~many], own[many]
        head = np.array([len(once), len(more)], np.int32)
        data = _bytes_of(head, one[once], one[more], short[once], short[more])
        yield 0, int(bucket[a]), data + _places(keys, doc[once], first[once])


def _read_candidates(data: bytes) -> tuple[np.ndarray, ...]:
    view = memoryview(data)
    once, more = np.frombuffer(view, np.int32, 2).tolist()
    n = once + more
    one = np.frombuffer(view, np.uint64, n, 8)
    two = np.frombuffer(view, np.uint32, n, 8 + 8 * n)
    keys, first = _read_places(view[8 + 12 * n :])
    return one[:once], two[:once], keys, first, one[once:], two[once:]


def _decided(blobs: list[bytes], groups: int) -> Iterator[tuple[int, int, bytes]]:
    """Exact groups of one bucket; the places of windows that occur again."""
    parts = [_read_candidates(b) for b in blobs]
    once = sum(len(p[0]) for p in parts)
    one = np.concatenate([*(p[0] for p in parts), *(p[4] for p in parts)])
    two = np.concatenate([*(p[1] for p in parts), *(p[5] for p in parts)])
    weight = np.ones(len(one), np.int64)
    weight[once:] = 2
    order = np.lexsort((two, one))
    new = np.ones(len(one), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    total = np.add.reduceat(weight[order], np.flatnonzero(new))
    again = np.zeros(len(one), bool)
    again[order] = (total > 1)[np.cumsum(new) - 1]
    keys = np.concatenate([p[2] for p in parts])
    first = np.concatenate([p[3] for p in parts])
    yield from _verdicts(keys[again[:once]], first[again[:once]], groups)


_ROUTED = "kind int, target int, data binary"


def _routed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, targets, data = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(targets, pa.int32()), pa.array(data, pa.binary())],
        ["kind", "target", "data"],
    )


def repeated_windows(keyed: DataFrame, width: int, total: int) -> tuple[DataFrame, int]:
    """Places of all repeated windows of ``text, key``, by group of documents, and the number of groups."""
    spark = keyed.sparkSession
    cells_each = 8 * parts_for(min(total / BYTES_PER_CELL, MOST_CELLS), 8 * CHUNKS)
    groups, buckets = parts_for(total, GROUP), parts_for(total / 16, BUCKET)
    held = spark.sparkContext.broadcast(sketch(keyed.select("text"), cells_each, width, groups))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hashers = held.value, [WordHasher(0), WordHasher(1)]
        kept: list[tuple] = []
        owners: list[np.ndarray] = []
        size = seen = 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*kept)]
            rows, amount = [], 0
            for row in _candidates(columns[0], columns[1], np.concatenate(owners), columns[2], columns[3], buckets, groups):
                rows.append(row)
                amount += len(row[2])
                if amount > 8 << 20:
                    yield _routed(rows)
                    rows, amount = [], 0
            if rows:
                yield _routed(rows)

        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            owners.append(keys)
            for (one, two), doc, first in windows(batch.column(0), hashers, width):
                hit = np.flatnonzero(estimated_twice(bitmap, one, cells_each))
                kept.append((one[hit], two[hit], doc[hit] + seen, first[hit]))
                size += len(hit)
                if size >= FLUSH:
                    yield from flush()
                    kept, size = [], 0
            seen += len(keys)
            if not size:  # no window is held, so neither are keys needed
                kept, owners, seen = [], [], 0
        if size:
            yield from flush()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs = None, []
        for batch in batches:
            for kind, target, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if kind == 1:
                    yield _routed([(kind, target, data)])
                    continue
                if target != current:
                    if blobs and (rows := list(_decided(blobs, groups))):
                        yield _routed(rows)
                    current, blobs = target, []
                blobs.append(data)
        if blobs and (rows := list(_decided(blobs, groups))):
            yield _routed(rows)

    found = keyed.select("text", "key").mapInArrow(find, _ROUTED)
    met = found.repartition(max(buckets, groups), "kind", "target").sortWithinPartitions("kind", "target")
    return met.mapInArrow(decide, _ROUTED).select(F.col("target").alias("_group"), F.col("data").alias("_data")), groups


# --- removal --------------------------------------------------------------------


def remove_repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW
) -> DataFrame:
    """``docs`` with ``n_words, n_removed, kept_text``.

    Words are runs of signs other than space, \\t, \\n, \\v, \\f and \\r. Each word goes
    that is covered by a window of ``width`` consecutive words of its document whose
    sequence starts anywhere else, too; the input decides, not what is left.
    ``kept_text`` has the other words, joined by one space.

    1. Tasks count their windows in count-min sketches, which are merged. The sketch
       never underestimates; its size follows the input up to a fixed bound, past
       which only more windows pass it.
    2. Windows estimated to occur twice go to buckets by their hashes (64 and 32
       independent bits) and are grouped there exactly.
    3. Repeated places meet their documents, by a hash of id and text.

    A window however common sends one entry per some million windows, and all
    steps work on streams or on parts of bounded size.

    Null, empty and blank texts have no words, and an empty kept text. Texts shorter
    than a window keep all words. Of repeated rows, each counts as an occurrence, so
    rows with the same id and text lose what a copy would. Empty tables give empty
    results, and input columns named like a result column are replaced.
    """
    docs = without(docs, [*RESULT, "_group", "_data", "_key"])
    key = F.xxhash64(id_col, text_col)
    keyed = docs.select(F.col(text_col).alias("text"), key.alias("key"))
    total = total_bytes(keyed)
    found, groups = repeated_windows(keyed, width, total)
    names = docs.columns
    at = names.index(text_col)
    # Unsigned remainder, as the tasks take it.
    unsigned = F.pmod(F.pmod(F.col("_key"), F.lit(groups)) + F.when(F.col("_key") < 0, F.lit(2**64 % groups)).otherwise(0), F.lit(groups))
    texts = docs.withColumn("_key", key).withColumn("_group", unsigned.cast("int"))
    both = texts.unionByName(found, allowMissingColumns=True)
    met = both.repartition(groups, "_group").sortWithinPartitions("_group", F.col("_data").isNull())
    schema = docs.selectExpr("*", "0L AS n_words", "0L AS n_removed", "'' AS kept_text").schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs, keys, firsts = None, [], None, None
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            group, data = columns["_group"].to_pylist(), columns["_data"].to_pylist()
            own = columns["_key"].to_pylist()
            text = batch.column(at).to_pylist()
            rows, n_words, n_removed, kept = [], [], [], []
            for i in range(batch.num_rows):
                if group[i] != current:
                    current, blobs, keys = group[i], [], None
                if data[i] is not None:
                    blobs.append(data[i])
                    continue
                if keys is None:
                    keys, firsts = _sorted_places(blobs)
                    blobs = []
                words = (text[i] or "").encode().split()
                a, z = np.searchsorted(keys, [own[i], own[i]], side="left")[0], np.searchsorted(keys, own[i], side="right")
                gone = 0
                if z > a:
                    cover = np.zeros(len(words) + width + 1, np.int64)
                    begin = np.unique(firsts[a:z])
                    cover[begin] += 1
                    cover[begin + width] -= 1
                    stay = np.cumsum(cover)[: len(words)] == 0
                    gone = len(words) - int(stay.sum())
                    words = [words[k] for k in np.flatnonzero(stay).tolist()]
                rows.append(i)
                n_words.append(len(words) + gone)
                n_removed.append(gone)
                kept.append(b" ".join(words).decode())
            if rows:
                picked = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*picked.columns[: len(names)], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                    [*names, *RESULT],
                )

    return met.select(*names, "_group", "_data", "_key").mapInArrow(clean, schema)


def _sorted_places(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if not blobs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = [_read_places(memoryview(b)) for b in blobs]
    keys = np.concatenate([p[0] for p in parts])
    firsts = np.concatenate([p[1] for p in parts]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    return keys[order], firsts[order]
