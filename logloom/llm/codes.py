"""Short codes of vectors: Lloyd rounds in which members stay with the owner of their entry."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import drop_table, join_unique, parts_for, shared_folder, stored

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Integers per unit of a component, and the largest integer: beyond it, at components of
#: over 32,768, integers stay there, so that no distance leaves 64 bits.
SCALE, LARGEST = 4096, 1 << 27
#: Members of one entry that live in one place; a fuller entry has several owners.
OWNED = 1 << 18
#: Differences held at once while parts are compared with entries.
_AT_ONCE = 1 << 20


class Codes(NamedTuple):
    """``rows``: id, label, ``codes`` (an index per part) and ``error``; ``codebooks`` by part, entry, place."""

    rows: DataFrame
    codebooks: np.ndarray


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of least squared distance for each part (the lower one of equals), and the distance."""
    entry, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    step = max(1, _AT_ONCE // max(book.size, 1))
    for a in range(0, len(parts), step):
        distance = ((parts[a : a + step, None, :] - book[None]) ** 2).sum(axis=2)
        entry[a : a + step] = distance.argmin(axis=1)
        error[a : a + step] = distance.min(axis=1)
    return entry, error


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def _judged(batch: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    position = batch.column("position").to_numpy()
    parts = _matrix(batch.column("part")).astype(np.int64)
    entry, error = np.zeros(len(position), np.int64), np.zeros(len(position), np.int64)
    for p in np.unique(position):
        own = position == p
        entry[own], error[own] = nearest(parts[own], books[p])
    return entry, error


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _cut(books: np.ndarray) -> Task:
    """Vectors into parts, each with its first entry. The first part carries id and label."""
    n_parts = len(books)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            vectors = integers(_matrix(batch.column("vector"))).reshape(n, n_parts, -1)
            for p in range(n_parts):
                parts = np.ascontiguousarray(vectors[:, p])
                width = parts.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, p, np.int32)),
                        pa.array(nearest(parts, books[p])[0].astype(np.int32)),
                        batch.column("row"),
                        batch.column("id") if p == 0 else pa.nulls(n, batch.column("id").type),
                        batch.column("label") if p == 0 else pa.nulls(n, batch.column("label").type),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)),
                            pa.array(parts.ravel().astype(np.int32)),
                        ),
                        pa.array(np.ones(n, bool)),
                    ],
                    ["position", "entry", "row", "id", "label", "part", "moved"],
                )

    return task


def _assign(books: np.ndarray) -> Task:
    """Resident parts with their nearest entry; ``moved`` says that another owner gets them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry = _judged(batch, books)[0].astype(np.int32)
            moved = entry != batch.column("entry").to_numpy()
            kept = [pa.array(entry) if name == "entry" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(moved)], [*batch.schema.names, "moved"])

    return task


def _final(books: np.ndarray) -> Task:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, error = _judged(batch, books)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(name) for name in ("row", "id", "label", "position")],
                    pa.array(entry.astype(np.int32)),
                    pa.array(error),
                ],
                ["row", "id", "label", "position", "entry", "error"],
            )

    return task


def _sums(entries: int, n_parts: int) -> Task:
    """Counts and componentwise sums of the members that live in a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = counts = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("position").to_numpy().astype(np.int64) * entries + batch.column("entry").to_numpy()
            parts = _matrix(batch.column("part")).astype(np.int64)
            if totals is None:
                totals = np.zeros((n_parts * entries, parts.shape[1]), np.int64)
                counts = np.zeros(n_parts * entries, np.int64)
            order = np.argsort(cell, kind="stable")
            own, firsts = np.unique(cell[order], return_index=True)
            totals[own] += np.add.reduceat(parts[order], firsts, axis=0)
            counts[own] += np.diff(np.append(firsts, len(order)))
        if totals is not None:
            used = np.flatnonzero(counts)
            width = totals.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(used, width)),
                    pa.array(np.tile(np.arange(width), len(used))),
                    pa.array(totals[used].ravel()),
                    pa.array(np.repeat(counts[used], width)),
                ],
                ["cell", "place", "total", "n"],
            )

    return task


def _updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries as the floored means of their members; an entry without members stays.

    What reaches the driver has the size of the codebooks, whatever the rows.
    """
    n_parts, entries, _ = books.shape
    own = members.select("position", "entry", "part").mapInArrow(
        _sums(entries, n_parts), "cell bigint, place bigint, total bigint, n bigint"
    )
    out = books.copy()
    for r in own.groupBy("cell", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["cell"] // entries, r["cell"] % entries, r["place"]] = r["total"] // r["n"]
    return out


def vector_codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> Codes:
    """Code every vector by the nearest codebook entry of each of its parts.

    Components become ``floor(4096 x)``. A part position's codebook begins as that
    part of the vectors with the least ids (nulls last; ties by the vector); each
    round assigns all parts (squared distance, ties to the lower entry) and makes an
    entry the floored mean of its parts.

    Parts live with the owner of (position, entry, salt), as a table written owner by
    owner. A round sums up members where they live, and judges them there again; only
    the parts that change their entry pass through the next shuffle. The salt spreads
    one entry over as many owners as it may need when it holds all rows.

    Rows with a null vector, or with null or non-finite components, are left out, and
    so are those whose length differs from that of the vector with the least id among
    lengths that ``parts`` divides. Components of over 32,768 count as 32,768.
    Repeated rows and ids are coded row by row; null ids and labels stay null. With
    fewer vectors than entries there are as many entries as vectors; an empty table
    gives none. Other columns are not read.
    """
    spark = vectors.sparkSession
    chosen = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.size("vector")
    sound = chosen.where(F.col("vector").isNotNull() & (length > 0) & (length % parts == 0) & finite)
    first = sound.orderBy(F.asc_nulls_last("id"), "vector").limit(1).collect()
    width = len(first[0]["vector"]) if first else parts
    sound = sound.where(length == width)
    least = sound.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    start = np.array([r["vector"] for r in least], np.float64).reshape(len(least), width)
    books = integers(start).reshape(len(least), parts, width // parts).transpose(1, 0, 2)

    rows = vectors.count()
    owners = parts_for(rows, OWNED)
    salt = F.pmod(F.xxhash64("row"), F.lit(owners)).cast("int")
    tasks = parts_for(rows * parts, OWNED)
    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    columns = (
        "position int, entry int, row bigint, "
        f"id {kinds['id']}, label {kinds['label']}, part array<int>"
    )
    numbered = sound.withColumn("row", F.monotonically_increasing_id())
    if not least:
        books = np.zeros((parts, 0, 1), np.int64)
        return Codes(numbered.select("id", "label", F.lit(None).cast("array<int>").alias("codes"),
                                     F.lit(0).cast("bigint").alias("error")), books)

    base = shared_folder(spark)

    def settled(frame: DataFrame, generation: int) -> str:
        path = f"{base}/codes-{generation}"
        frame.write.partitionBy("moved").option("compression", "zstd").parquet(path)
        return path

    def read(path: str) -> DataFrame:
        return spark.read.schema(f"{columns}, moved boolean").parquet(path)

    def owned(path: str) -> DataFrame:
        """Residents where they are, and what moved at its new owners."""
        here = read(path)
        moved = here.where("moved").drop("moved").withColumn("salt", salt)
        moved = moved.repartition(tasks, "position", "entry", "salt").drop("salt")
        return here.where("NOT moved").drop("moved").unionByName(moved)

    path = settled(numbered.mapInArrow(_cut(books), f"{columns}, moved boolean"), 0)
    for k in range(rounds):
        before, books = books, _updated(read(path), books)
        if k == rounds - 1 or np.array_equal(before, books):
            break  # the same entries would assign all parts alike in every later round
        following = settled(owned(path).mapInArrow(_assign(books), f"{columns}, moved boolean"), k + 1)
        drop_table(spark, path)
        path = following
    held = f"row bigint, id {kinds['id']}, label {kinds['label']}, position int, entry int, error bigint"
    judged = read(path).drop("moved").mapInArrow(_final(books), held)
    pair = F.sort_array(F.collect_list(F.struct("position", "entry")))
    rows = judged.groupBy("row").agg(
        F.max("id").alias("id"), F.max("label").alias("label"), pair.alias("pairs"), F.sum("error").alias("error")
    )
    return Codes(rows.select("id", "label", F.col("pairs.entry").alias("codes"), "error"), books)


def decoded(codes: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """The vectors that rows of codes stand for, in units of one."""
    parts = [codebooks[p][codes[:, p]] for p in range(len(codebooks))]
    return np.concatenate(parts, axis=1) / SCALE


def digests(coded: Codes, id_col: str = "vec_id") -> DataFrame:
    """Codes as hexadecimal text, errors summed by label, and a digest of all codebooks."""
    rows = stored(coded.rows, "coded")
    hexes = F.transform("codes", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0"))
    # Nulls are a label like any other.
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    labelled = rows.withColumn("label", label)
    sums = labelled.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    sums = stored(sums, "labels")
    whole = join_unique(labelled, sums.drop("n"), ["label"], ["id", "codes"], "inner", sums.select("label", "n"))
    text = ",".join(map(str, coded.codebooks.ravel().tolist()))
    return whole.select(
        F.col("id").alias(id_col),
        F.array_join(hexes, "").alias("code"),
        "error",
        "label_error",
        F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"),
    )
