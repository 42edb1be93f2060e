"""Helpers the operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """New folder below the one that the cluster names in ``spark.checkpoint.dir``.

    Only a session inside one process may go without that setting; it gets a
    temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append(tempfile.mkdtemp(prefix="logloom-"))
        folder = f"file://{_OWN_FOLDER[0]}"
    return f"{folder}/logloom-llm-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: later reads neither recompute them nor depend on executors."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table of an earlier step that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # lower() would also change letters beyond ASCII; without any it is the same and faster.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def total_bytes(texts: DataFrame, column: str = "text") -> int:
    """UTF-8 length of all texts."""
    return texts.select(F.sum(F.octet_length(column))).first()[0] or 0


def parts_for(amount: float, each: float, least: int = 1) -> int:
    """Number of parts of about ``each``, so that a part's size does not grow with the data."""
    return max(least, int(-(-amount // each)))


#: Keys with more than a thousandth of the rows are dealt over several tasks; few rows never are.
HEAVY_SHARE, HEAVY_LEAST = 1000, 200


def join_unique(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    counts: DataFrame | None = None,
    known: tuple[int, int] | None = None,
) -> DataFrame:
    """Join each row of ``left`` with the one row of ``right`` that has its keys.

    ``right`` has a row per key at most. A key may hold any share of ``left``:
    keys with over a thousandth of its rows (fewer than a thousand keys, so their
    list may be broadcast) are dealt over several tasks by the columns in
    ``spread``, and their row of ``right`` goes to each of these. ``counts`` gives
    rows per key as ``keys, n`` where they are known, ``known`` their sum and the largest.
    """
    keys = list(keys)
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total, most = known or counts.agg(F.sum("n"), F.max("n")).first()
    if not total or most <= HEAVY_LEAST or most * HEAVY_SHARE <= total:
        return left.join(right, keys, how)
    often = (F.col("n") > HEAVY_LEAST) & (F.col("n") * HEAVY_SHARE > total)
    fan = F.ceil(F.col("n") * HEAVY_SHARE / F.lit(total)).cast("int").alias("_fan")
    listed = counts.where(often).select(*keys, fan)
    heavy = F.broadcast(left.sparkSession.createDataFrame(listed.collect(), listed.schema))
    salt = F.when(
        F.col("_fan").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("_fan")).cast("int")
    ).otherwise(0)
    dealt = left.join(heavy, keys, "left").withColumn("_salt", salt).drop("_fan")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_fan") - 1, F.lit(0))))
    copied = right.join(heavy, keys, "left").withColumn("_salt", copies).drop("_fan")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")


def without(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns of the input that carry the name of a result column give way to it."""
    return frame.drop(*[c for c in frame.columns if c.lower() in {n.lower() for n in names}])


# --- connected components ----------------------------------------------------


def _least_of(links: DataFrame) -> DataFrame:
    """Per node ``u`` its least neighbour ``m`` and the number ``n`` of its links."""
    return links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the links ``a, b``; a component is named by its least node.

    Large-star and small-star steps by turns, each a grouped minimum and a join, so
    that the number of rounds grows with the logarithm of the longest path. Hubs
    are dealt over several tasks. Each round is a written table; none is spent on
    links that are stars already.
    """
    pairs = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = _least_of(both)
        # In a star a node has one neighbour, or only greater ones.
        *known, unlike = ends.agg(F.sum("n"), F.max("n"), F.max(F.expr("m < u AND n > 1"))).first()
        if not unlike:
            break
        least = ends.select("u", F.least("m", "u").alias("m"))
        large = join_unique(both, least, ["u"], ["v"], "inner", ends.select("u", "n"), known).where("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        # In the small star every node links its smaller neighbours to the least of them.
        low = _least_of(large)
        small = join_unique(large, low.drop("n"), ["u"], ["v"], "inner", low.select("u", "n"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        pairs = stored(small, "edges")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


# --- texts in Arrow batches ---------------------------------------------------

#: Rows that go to a Python worker at once; the default of 10,000 long texts would fill it.
BATCH_ROWS = 1000


def small_batches(frame: DataFrame) -> DataFrame:
    """The frame, in a session that hands texts to workers in small batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = frame.sparkSession
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return frame


def frugal(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The task of a worker, which hands back at its end what it held at its height.

    Spark keeps workers for later tasks, and takes the one that rested longest: without
    this all workers that ever ran together stay as large as their largest task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run


def release_memory() -> None:
    """Give free memory of this process back to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column of strings, and where each begins; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    starts = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), starts
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole documents with up to ``limit`` bytes; a longer document is a run of its own."""
    begin, n = 0, len(starts) - 1
    while begin < n:
        end = int(np.searchsorted(starts, starts[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), n)
        yield begin, end
        begin = end


# --- words and their hashes ---------------------------------------------------

#: Bytes as they are, 0 for those between words: space and \t \n \v \f \r.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[0x20, *range(0x09, 0x0E)]] = 0
#: The same with A-Z in lower case.
LOWERED = PLAIN.copy()
LOWERED[0x41:0x5B] += 0x20
#: Only letters, digits and bytes beyond ASCII, A-Z in lower case.
ALNUM = np.zeros(256, np.uint8)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_a:_b] = LOWERED[_a:_b]

_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash, so that each bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """Hashes of words and of runs of words, 64 bits per seed, over whole arrays at once."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(7_000 + seed)
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1, 2**61)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self._up = self._down = np.zeros(0, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self._up) < n:
            size = max(n, _BLOCK + 1)
            self._up, self._down = _powers(self.base, size), _powers(self.inverse, size)

    def words(self, mapped: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash for each run of bytes ``mapped[begin:end]``."""
        out = np.empty(len(begin), np.uint64)
        at = 0
        while at < len(begin):  # blocks of bytes, so that temporary arrays stay small
            first = int(begin[at])
            stop = max(int(np.searchsorted(end, first + _BLOCK, side="right")), at + 1)
            last = int(end[stop - 1])
            self._reach(last - first + 1)
            run = np.zeros(last - first + 1, np.uint64)
            np.multiply(self.values[mapped[first:last]], self._up[: last - first], out=run[1:])
            np.cumsum(run, out=run)
            left = begin[at:stop] - first
            out[at:stop] = (run[end[at:stop] - first] - run[left]) * self._down[left]
            at = stop
        return mix(out)

    def runs(self, words: np.ndarray, width: int) -> np.ndarray:
        """A hash for the ``width`` words from each place on, document borders ignored."""
        n = len(words) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.empty(n, np.uint64)
        for at in range(0, n, _BLOCK):
            stop = min(n, at + _BLOCK)
            part = words[at : stop + width - 1]
            self._reach(len(part) + 1)
            run = np.zeros(len(part) + 1, np.uint64)
            np.multiply(part, self._up[: len(part)], out=run[1:])
            np.cumsum(run, out=run)
            size = stop - at
            out[at:stop] = (run[width : width + size] - run[:size]) * self._down[:size]
        return mix(out)


def word_spans(
    data: np.ndarray, starts: np.ndarray, table: np.ndarray = PLAIN
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mapped bytes, begin and end of each word, and words per document."""
    mapped = table[data]
    inside = np.zeros(len(data) + 1, bool)
    np.not_equal(mapped, 0, out=inside[:-1])
    border = np.zeros(len(data) + 1, bool)
    border[starts] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | border[1:]
    begin = np.flatnonzero(begins)
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = inside[:-1] & (~inside[1:] | border[1:])
    end = np.flatnonzero(ends)
    counts = np.diff(np.searchsorted(begin, starts))
    return mapped, begin, end, counts


# --- rows with wanted keys ------------------------------------------------------

#: Slots of a filter per key, of the smallest and of the largest filter: four million words, some 200 MB.
SLOTS_PER_KEY, LEAST_SLOTS, MOST_SLOTS = 8, 1 << 15, 1 << 28
#: Bits of a word, as a power of two.
_BITS = 6


def slots_for(keys: int) -> int:
    """Slots of a filter for so many keys: a power of two, of which an eighth is taken at most."""
    return max(LEAST_SLOTS, 1 << (SLOTS_PER_KEY * keys - 1).bit_length())


def marked(frame: DataFrame, keys: DataFrame, names: Sequence[str], mark: str, most: int | None = None) -> DataFrame:
    """``frame`` with a boolean ``mark``: true for all rows whose ``names`` are in ``keys``, and for few others.

    The keys become one bit each of a filter that grows with their number and is
    broadcast. Rows that are not marked need not be shuffled to find those with the
    keys. Keys that need a filter beyond ``most`` slots have none: all rows are
    marked, and the join that follows sorts them out. Null is a key like any other.
    """
    slots = slots_for(keys.count())
    if slots > (MOST_SLOTS if most is None else most):
        return frame.withColumn(mark, F.lit(True))
    place = F.pmod(F.xxhash64(*names), F.lit(slots))
    bit = F.col("_slot") % (1 << _BITS)
    word = F.shiftright("_slot", _BITS).alias("_word")
    bits = keys.select(place.alias("_slot")).select(word, bit.alias("_bit"))
    own = F.expr("bit_or(shiftleft(1L, cast(_bit AS int)))").alias("_bits")
    bits = stored(bits.groupBy("_word").agg(own), "slots")
    here = frame.withColumn("_slot", place).select("*", word)
    taken = F.getbit("_bits", bit.cast("int")) == 1
    met = here.join(F.broadcast(bits), "_word", "left")
    return met.withColumn(mark, F.coalesce(taken, F.lit(False))).drop("_word", "_slot", "_bits")
