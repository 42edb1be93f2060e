"""Documents with similar word n-grams: MinHash candidates, Bayesian pruning, exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import (
    LOWERED,
    WordHasher,
    components,
    frugal,
    join_unique,
    marked,
    mix,
    slices,
    small_batches,
    stored,
    text_buffer,
    without,
    word_spans,
)
from logloom.llm.pieces import ranges

WORDS, THRESHOLD = 5, 0.8
#: MinHash values, and how they are cut into bands of candidates: a pair at the threshold
#: shares no band with probability (1 - 0.8^5)^25, one in 20,000; above it less.
HASHES, BANDS, ROWS = 128, 25, 5
#: Values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Members of a candidate component that are compared with one another in one place.
BLOCK = 256
#: Shingles of such a block, roughly; a component of long texts is cut into more blocks.
BLOCK_SHINGLES = 1 << 18
RESULT = ("class_id", "n_links")

_SLICE = 1 << 20
_HASHER = WordHasher(3)
_RNG = np.random.default_rng(99)
_TIMES = _RNG.integers(1, 2**62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingles(data: np.ndarray, starts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document in order, and the document of each.

    A document with fewer words has one shingle of all its words.
    """
    mapped, begin, end, counts = word_spans(data, starts, LOWERED)
    own = _HASHER.words(mapped, begin, end)
    doc = np.repeat(np.arange(len(counts)), counts)
    run = _HASHER.runs(own, words)
    whole = doc[: len(run)] == doc[words - 1 : words - 1 + len(run)]
    values, owner = run[whole], doc[: len(run)][whole]
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        few = np.array([_HASHER.runs(own[first[k] : first[k] + counts[k]], int(counts[k]))[0] for k in short], np.uint64)
        values, owner = np.concatenate((values, mix(few + counts[short].astype(np.uint64)))), np.concatenate((owner, short))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], owner[new]


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of compared values, the least number of equal ones with which a pair stays.

    With a uniform prior the similarity given m of n equal values follows
    Beta(m + 1, n - m + 1), which exceeds the threshold with the probability that a
    binomial of n + 1 trials gives at most m.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        chance, total, m = (1 - threshold) ** (n + 1), 0.0, 0
        while True:
            total += chance
            if total >= tolerance or m > n:
                break
            chance *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
            m += 1
        out.append(m)
    return out


_SIGNED = "set_key binary, n_shingles int, signature binary"


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: the id, a 128-bit key of the shingle set (null without words), and MinHash values."""
    chosen = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffer(batch.column(1))
            n = batch.num_rows
            keys: list[bytes | None] = [None] * n
            signed: list[bytes | None] = [None] * n
            size = np.zeros(n, np.int32)
            for a, z in slices(starts, _SLICE):
                cut = starts[a : z + 1]
                values, owner = shingles(data[cut[0] : cut[-1]], cut - cut[0])
                if not len(values):
                    continue
                firsts = np.flatnonzero(np.diff(owner, prepend=-1))
                docs_here = owner[firsts] + a
                one, two = np.add.reduceat(mix(values), firsts), np.add.reduceat(mix(~values), firsts)
                size[docs_here] = np.diff(np.append(firsts, len(values)))
                least = np.empty((len(firsts), HASHES), np.uint32)
                for k in range(HASHES):
                    least[:, k] = np.minimum.reduceat(values * _TIMES[k] + _PLUS[k], firsts) >> np.uint64(32)
                both = np.stack((one, two), axis=1)
                for i, doc in enumerate(docs_here.tolist()):
                    keys[doc], signed[doc] = both[i].tobytes(), least[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(size), pa.array(signed, pa.binary())],
                ["id", "set_key", "n_shingles", "signature"],
            )

    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(frugal(task), f"id {kind}, {_SIGNED}")


def candidate_components(classes: DataFrame) -> DataFrame:
    """``node, component, size`` of classes that share a band with another.

    ``size`` counts members; where texts are long it grows, so that blocks hold fewer.
    """
    width = 4 * ROWS
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.xxhash64(b, F.substring("signature", b * width + 1, F.lit(width))),
    )
    members = stored(classes.select("node", F.explode(keys).alias("band")), "bands")
    buckets = members.groupBy("band").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stored(buckets, "buckets")
    shared = join_unique(members, buckets.drop("n"), ["band"], ["node"], "inner", buckets.select("band", "n"))
    # A node goes with the least lead of its bands; what is left to connect are the leads
    # that a node has in common, which are few where a group of copies is large.
    led = shared.groupBy("node").agg(F.collect_set("lead").alias("leads"))
    led = stored(led.select("node", "leads", F.array_min("leads").alias("parent")), "led")
    pairs = led.select(F.explode("leads").alias("a"), F.col("parent").alias("b")).where("a <> b")
    tops = components(pairs).select(F.col("node").alias("parent"), "component")
    known = join_unique(led.select("node", "parent"), tops, ["parent"], ["node"])
    found = known.select("node", F.coalesce("component", "parent").alias("component"))
    weighed = found.join(classes.select("node", "n_shingles"), "node")
    long = F.ceil(F.sum("n_shingles") * BLOCK / BLOCK_SHINGLES)
    sizes = weighed.groupBy("component").agg(F.count(F.lit(1)).alias("n"), long.cast("bigint").alias("long"))
    sizes = stored(sizes.select("component", "n", F.greatest("n", "long").alias("size")), "sizes")
    counts = sizes.select("component", "n")
    return join_unique(found, sizes.drop("n"), ["component"], ["node"], "inner", counts)


def _with_shingles(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Shingle sets of the wanted classes, from the text of one of their documents."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = marked(texts, wanted, ["id"], "_hit").where("_hit").drop("_hit")
    # Null is an id like any other here.
    met = texts.alias("t").join(wanted.alias("w"), F.col("t.id").eqNullSafe(F.col("w.id")))
    chosen = met.select("text", "set_key", "node", "component", "size", "copies", "signature")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffer(batch.column(0))
            for a, z in slices(starts, _SLICE):  # handed on slice by slice, so that little is held
                cut, part = starts[a : z + 1], batch.slice(a, z - a)
                values, owner = shingles(data[cut[0] : cut[-1]], cut - cut[0])
                if not len(values):
                    continue
                firsts = np.flatnonzero(np.diff(owner, prepend=-1))
                one, two = np.add.reduceat(mix(values), firsts), np.add.reduceat(mix(~values), firsts)
                ends = np.append(firsts[1:], len(values))
                keys = part.column(1).to_pylist()
                rows, sets = [], []
                for k, doc in enumerate(owner[firsts].tolist()):
                    # Another row may have the same id.
                    if np.array([one[k], two[k]]).tobytes() == keys[doc]:
                        rows.append(doc)
                        sets.append(values[firsts[k] : ends[k]].tobytes())
                picked = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*picked.columns[2:], pa.array(sets, pa.binary())], [*part.schema.names[2:], "shingles"]
                )

    kinds = "node bigint, component bigint, size bigint, copies bigint, signature binary, shingles binary"
    return chosen.mapInArrow(frugal(task), kinds)


def linked_pairs(
    signed: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sets are similar: pruned by their MinHash values, the rest counted exactly."""
    matches = np.zeros(len(left), np.int64)
    for k, least in enumerate(least_matches(threshold)):
        span = slice(k * STEP, (k + 1) * STEP)
        matches += (signed[left, span] == signed[right, span]).sum(axis=1)
        stay = matches >= least
        left, right, matches = left[stay], right[stay], matches[stay]
        if not len(left):
            return left, right
    size = np.array([len(s) for s in sets], np.int64)
    begin = np.cumsum(size) - size
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.zeros(len(left), np.int64)
    mark = np.zeros(len(names), bool)
    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    cuts = np.append(np.flatnonzero(np.diff(left, prepend=-1)), len(left))
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = ids[begin[left[a]] : begin[left[a]] + size[left[a]]]
        mark[own] = True
        others = right[a:z]
        hits = mark[ids[ranges(size[others], begin[others])]]
        shared[a:z] = np.add.reduceat(hits, np.cumsum(size[others]) - size[others], dtype=np.int64)
        mark[own] = False
    union = size[left] + size[right] - shared
    linked = shared >= threshold * union - 1e-9
    return left[linked], right[linked]


def _spanning(left: list[int], right: list[int]) -> Iterator[tuple[int, int]]:
    """Links that join parts not joined before."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(left, right):
        x, y = top(a), top(b)
        if x != y:
            parent[x] = y
            yield a, b


def _links(members: DataFrame, threshold: float) -> DataFrame:
    """Per class the documents linked with it, and links that connect all linked classes.

    A large candidate component is cut into blocks; every pair of blocks meets in one
    place, where pairs are judged in arrays. What leaves is a count per member and a
    spanning forest, never the pairs.
    """
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "node", "copies", "signature", "shingles",
    )
    keys = ["component", "low", "high"]
    met = dealt.repartition(*keys).sortWithinPartitions(*keys, "node")

    def judge(rows: list[tuple]) -> list[tuple]:
        low, high = rows[0][1:3]
        seen: set[int] = set()
        rows = [r for r in rows if not (r[4] in seen or seen.add(r[4]))]
        block = np.array([r[3] for r in rows])
        nodes, copies = [r[4] for r in rows], np.array([r[5] for r in rows], np.int64)
        signed = np.stack([np.frombuffer(r[6], np.uint32) for r in rows])
        sets = [np.frombuffer(r[7], np.uint64) for r in rows]
        if low == high:
            left, right = np.triu_indices(len(rows), 1)
        else:
            left, right = (x.ravel() for x in np.meshgrid(np.flatnonzero(block == low), np.flatnonzero(block == high)))
        left, right = linked_pairs(signed, sets, left, right, threshold)
        found = np.zeros(len(rows), np.int64)
        np.add.at(found, left, copies[right])
        np.add.at(found, right, copies[left])
        out = [(nodes[i], int(found[i]), None) for i in np.flatnonzero(found).tolist()]
        return out + [(nodes[a], 0, nodes[b]) for a, b in _spanning(left.tolist(), right.tolist())]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "linked", "other"])

        current, held, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != current:
                    if len(held) > 1:
                        out += judge(held)
                    current, held = row[:3], []
                held.append(row)
                if len(out) > 50_000:
                    yield batch_of(out)
                    out = []
        if len(held) > 1:
            out += judge(held)
        if out:
            yield batch_of(out)

    return met.mapInArrow(frugal(task), "node bigint, linked bigint, other bigint")


def similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``: its id, ``class_id`` and ``n_links``.

    Two documents are linked if the Jaccard similarity of their sets of five-word
    shingles (A-Z in lower case; words as in a split at white space) is at least
    ``threshold``. ``n_links`` counts the documents linked with this one, copies
    included; ``class_id`` is the largest id among all that links lead to.

    Documents with equal sets are one class from the start. Classes that share a band
    of MinHash values are put in candidate components; inside, pairs are compared
    value by value in steps, dropped once the posterior probability of reaching the
    threshold falls below the tolerance, and counted exactly otherwise. There is no
    limit on members, partners or candidates.

    A document with one to four words has one shingle of all its words. Null, empty
    and blank texts have no links and are classes of their own. Repeated rows link
    with each other as copies do. A null id is the smallest. Empty tables give empty
    results. Other columns are not read.
    """
    signed = stored(signatures(docs, id_col, text_col), "signatures")
    filled = signed.where("set_key IS NOT NULL")
    classes = filled.groupBy("set_key").agg(
        F.max("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"),
        F.first("n_shingles").alias("n_shingles"),
    )
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = candidate_components(classes)
    wanted = stored(found.join(classes, "node").withColumn("id", F.col("rep")), "wanted")
    members = _with_shingles(docs, wanted.drop("rep"), id_col, text_col)
    links = stored(_links(members, threshold), "links")
    counted = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    joined = components(links.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = joined.join(classes.select("node", "rep"), "node")
    sizes = named.groupBy("component").agg(F.max("rep").alias("top"), F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes, "sizes")
    top = join_unique(joined, sizes.drop("n"), ["component"], ["node"], "inner", sizes.select("component", "n"))
    labelled = (
        classes.select("node", "set_key", "rep", "copies")
        .join(counted, "node", "left")
        .join(top.select("node", "top"), "node", "left")
    )
    labelled = labelled.select(
        "set_key",
        F.coalesce("top", "rep").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
    )
    rows = join_unique(
        filled.select("id", "set_key"), labelled, ["set_key"], ["id"], "inner",
        classes.select("set_key", F.col("copies").alias("n")),
    )
    blank = signed.where("set_key IS NULL").select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return rows.select("id", "class_id", "n_links").unionByName(blank).withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the document of the largest id left of each class.

    Rows with the same id share a fate. Documents whose id is in no filter slot of a
    dropped one pass by without a shuffle.
    """
    found = similar(docs, id_col, text_col, threshold)
    dropped = stored(found.where(F.col(id_col) < F.col("class_id")).select(id_col).distinct(), "dropped")
    here = marked(without(docs, ["_slot", "_word", "_bits", "_hit"]), dropped, [id_col], "_hit")
    safe = here.where(~F.col("_hit")).drop("_hit")
    return safe.unionByName(here.where("_hit").drop("_hit").join(dropped, id_col, "left_anti"))
