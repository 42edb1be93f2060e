"""Draw documents like a target: importance weights from hashed n-grams, exact ranks by sample sorting."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import ALNUM, parts_for, slices, stored, text_buffer, word_spans

WORDS, BUCKETS, SEED = 1, 10_000, 2024
#: Words a document needs to be drawn, and the share that is drawn.
LEAST_WORDS, PERCENT = 20, 10
#: Rows of a segment, the most segments there are (they grow instead), and samples per segment.
SEGMENT, MOST_SEGMENTS, SAMPLES = 1 << 14, 4096, 64

_SLICE = 1 << 20
_LONG = 64


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out.astype(np.uint32)


_CRC = _crc_table()


def crc32_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes ``data[begin:end]``, all runs a byte at a time."""
    size = end - begin
    order = np.argsort(-size, kind="stable")
    out = np.zeros(len(begin), np.uint32)
    far = int(np.count_nonzero(size > _LONG))
    for k in order[:far].tolist():  # few runs are long
        out[k] = zlib.crc32(data[begin[k] : end[k]].tobytes())
    order = order[far:]
    state, at, left = np.full(len(order), 0xFFFFFFFF, np.uint32), begin[order], size[order]
    alive = len(order)
    for k in range(int(left[0]) if alive else 0):
        alive = int(np.searchsorted(-left[:alive], -k, side="left"))
        part = state[:alive]
        state[:alive] = _CRC[(part ^ data[at[:alive] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out[order] = ~state
    return out


def features(
    data: np.ndarray, starts: np.ndarray, words: int = WORDS, buckets: int = BUCKETS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of every run of 1 to ``words`` words, and words per document."""
    mapped, begin, end, counts = word_spans(data, starts, ALNUM)
    owner = np.repeat(np.arange(len(counts)), counts)
    if words > 1 and len(begin):  # words joined by one space, so that a run of them is a run of bytes
        size = end - begin
        joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        to = np.cumsum(size + 1) - (size + 1)
        joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = mapped[mapped != 0]
        mapped, begin, end = joined, to, to + size
    found, docs = [], []
    for n in range(1, words + 1):
        if len(begin) < n:
            break
        whole = owner[: len(owner) - n + 1] == owner[n - 1 :]
        first = np.flatnonzero(whole)
        found.append(crc32_of(mapped, begin[first], end[first + n - 1]) % np.uint32(buckets))
        docs.append(owner[first])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    return np.concatenate(found).astype(np.int64), np.concatenate(docs), counts


def bucket_counts(texts: DataFrame, text_col: str, words: int, buckets: int) -> np.ndarray:
    """Features per bucket of a whole table. A task sends one row per bucket at most."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, starts = text_buffer(batch.column(0))
            for a, z in slices(starts, _SLICE):
                cut = starts[a : z + 1]
                own = features(data[cut[0] : cut[-1]], cut - cut[0], words, buckets)[0]
                total += np.bincount(own, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counted = texts.select(text_col).mapInArrow(task, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, target over all."""
    total, wanted, n = float(all_counts.sum()), float(target_counts.sum()), len(all_counts)
    ratios = ((target_counts + 1.0) * (total + n)) / ((all_counts + 1.0) * (wanted + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


_SCORED = "n_words bigint, n_features bigint, weight bigint, score bigint"


def scored(
    docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, words: int = WORDS, seed: int = SEED
) -> DataFrame:
    """Weight and randomised score of each document; the array of gains is all a task needs."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    chosen = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.conv(F.substring(drawn, 1, 8), 16, 10).cast("bigint").alias("h"),
    )
    kind = chosen.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffer(batch.column("text"))
            for a, z in slices(starts, _SLICE):
                cut, part = starts[a : z + 1], batch.slice(a, z - a)
                own, owner, n_words = features(data[cut[0] : cut[-1]], cut - cut[0], words, len(gains))
                n = np.bincount(owner, minlength=z - a)
                total = np.zeros(z - a, np.int64)
                np.add.at(total, owner, gains[own])
                weight = total // np.maximum(n, 1)
                u = (part.column("h").to_numpy() + 0.5) / 4294967296.0
                score = weight + np.floor(-1000 * np.log(-np.log(u))).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *map(pa.array, (n_words.astype(np.int64), n.astype(np.int64), weight, score))],
                    ["id", "n_words", "n_features", "weight", "score"],
                )

    return chosen.mapInArrow(task, f"id {kind}, {_SCORED}")


# --- exact ranks by sorting with regular samples --------------------------------
#
# Key of a row: score downwards, then id (null last), then run and place, which make
# every key different. So also rows that repeat one id a million times fall apart.


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("id"), F.asc("weight"), F.asc("n_features")]


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    columns = (batch.column(name).to_pylist() for name in ("score", "id", "run", "place"))
    return [(-s, i is None, 0 if i is None else i, r, p) for s, i, r, p in zip(*columns)]


def _sorted_runs(rows: DataFrame) -> DataFrame:
    """Each task's rows in order, with the task as ``run`` and the ``place`` in it."""
    ordered = rows.sortWithinPartitions(*_order())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            more = [pa.array(np.full(n, run, np.int64)), pa.array(np.arange(at, at + n))]
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "run", "place"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return stored(ordered.mapInArrow(task, f"{kinds}, run bigint, place bigint"), "runs")


def _splitters(runs: DataFrame, n: int, segments: int) -> list[tuple]:
    """Keys that cut all rows into segments of about one size, from regular samples of each run."""
    step = max(1, n // (SAMPLES * segments))
    picked = runs.where(F.col("place") % step == 0).select("score", "id", "run", "place").toArrow()
    keys = sorted(key for batch in picked.to_batches() for key in _keys(batch))
    return [keys[len(keys) * k // segments] for k in range(1, segments)] if keys else []


def _in_segments(runs: DataFrame, splitters: list[tuple]) -> DataFrame:
    """Rows with the number of splitters up to their key, found piece by piece of a run."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            run, at = batch.column("run").to_numpy(), batch.column("place").to_numpy()
            # Several files may meet in a batch; rows in a row of one run are in order.
            cuts = np.flatnonzero((np.diff(run) != 0) | (np.diff(at) != 1)) + 1
            keys = _keys(batch)
            segment = np.empty(len(keys), np.int32)
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                low, high = bisect_right(splitters, keys[a]), bisect_right(splitters, keys[z - 1])
                segment[a:z] = low
                for s in splitters[low:high]:
                    segment[bisect_left(keys, s, a, z) : z] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment)], [*batch.schema.names, "segment"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    return runs.mapInArrow(task, f"{kinds}, segment int")


def ranked(rows: DataFrame, share: tuple[int, int], segment_rows: int = SEGMENT) -> DataFrame:
    """``rows`` (``id, n_features, weight, score``) with the rank of the best; null for the others.

    Runs are sorted where they are; regular samples of them give splitters; only the
    segments that hold drawn rows are exchanged, and each is merged in one place. The
    counts of the segments before it give the ranks of its rows. To the driver come
    samples (64 per segment, at most 4,096 segments, and one more per run of a file
    split) and a count per segment.
    """
    runs = _sorted_runs(rows)
    n = runs.count()
    wanted = n * share[0] // share[1]
    segments = min(MOST_SEGMENTS, parts_for(n, segment_rows))
    splitters = _splitters(runs, n, segments)
    dealt = _in_segments(runs, splitters)
    counts = [0] * segments
    for r in dealt.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["segment"]] = r["n"]
    before = [0, *accumulate(counts)]
    last = sum(b < wanted for b in before[:-1])
    names = ["id", "n_features", "weight", "score"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            own = batch.column("segment").to_numpy()
            rank = np.empty(len(own), np.int64)
            for s in np.unique(own).tolist():
                here = own == s
                at = seen.get(s, before[s])
                rank[here] = np.arange(at + 1, at + 1 + int(here.sum()))
                seen[s] = at + int(here.sum())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(x) for x in names], pa.array(rank, mask=rank > wanted)], [*names, "rank"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    result = f"id {kind}, n_features bigint, weight bigint, score bigint, rank bigint"
    unranked = dealt.where(F.col("segment") >= last).select(*names, F.lit(None).cast("bigint").alias("rank"))
    if not last:
        return unranked
    moved = dealt.where(F.col("segment") < last).repartitionById(last, F.col("segment"))
    merged = moved.sortWithinPartitions("segment", *_order(), "run", "place")
    return merged.mapInArrow(task, result).unionByName(unranked)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    words: int = WORDS,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    segment_rows: int = SEGMENT,
) -> DataFrame:
    """Per row of ``docs``: its id, ``n_features``, ``weight``, ``score`` and ``rank``.

    A document's weight is the floored mean of its features' gains: logs of the share
    of a feature's bucket in the target texts over that in all documents. A random
    number that follows from seed and id is added, so that the best scores are a draw
    without replacement. Of the documents with at least ``least_words`` words
    ``percent`` in a hundred are drawn and numbered in order of their score, ties by
    the lesser id; the rank of all others is null.

    Null and empty texts have no features and weight 0. A null id is hashed as empty
    text and comes after all others in ties; rows that repeat an id are ranked one by
    one, equal rows in any order. An empty target leaves the shares of the documents;
    an empty table gives an empty result. Other columns are not read.
    """
    gains = bucket_gains(
        bucket_counts(docs, text_col, words, buckets), bucket_counts(target, target_col, words, buckets)
    )
    rows = stored(scored(docs, gains, id_col, text_col, words, seed), "scored")
    names = ["id", "n_features", "weight", "score"]
    best = ranked(rows.where(F.col("n_words") >= least_words).select(*names), (percent, 100), segment_rows)
    short = rows.where(F.col("n_words") < least_words).select(*names, F.lit(None).cast("bigint").alias("rank"))
    return best.unionByName(short).withColumnRenamed("id", id_col)
