"""Token ids packed into rows of one length, as binary matrices."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Files of public tokenizers; read by the driver only.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Way to cut text into pieces before merging, fixed by that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: First id that the vocabulary leaves free: end of text.
END = 50256
ROW = 2048
#: Tokens that one task packs together; bounds its memory.
SHARD_TOKENS = 1 << 22
#: Rows of a matrix in one record.
BLOCK_ROWS = 64
#: Vocabulary files larger than this are not sent to the tasks.
MAX_VOCABULARY = 64 << 20

SCHEMA = (
    "shard string, block int, n_rows int, row_tokens int, ids binary, positions binary, "
    "cu_seqlens array<int>, doc_ids array<bigint>, doc_starts array<bigint>"
)


def read_bytes(path: str, limit: int = MAX_VOCABULARY) -> bytes:
    with open(path, "rb") as file:
        data = file.read(limit + 1)
    if len(data) > limit:
        raise ValueError(f"{path} has over {limit} bytes")
    return data


class Encoder:
    """Byte-level BPE to ids of two bytes, with words seen before kept at hand."""

    KEEP = 1 << 19

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {
            base64.b64decode(piece): int(rank)
            for piece, rank in (line.split() for line in vocabulary.splitlines() if line)
        }
        self._bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._known: dict[str, bytes] = {}
        self._blank = re.compile(r" \s")

    def whole(self, text: str) -> bytes:
        return np.array(self._bpe.encode_ordinary(text), np.uint16).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 16-bit numbers.

        A single space before a visible sign always begins a piece, so that words
        can be looked up one by one; texts with other white space after a space are
        encoded in one go.
        """
        if self._blank.search(text) or text.endswith(" "):
            return self.whole(text)
        words = text.split(" ")
        known = self._known
        out = [self.whole(words[0])]
        try:
            out.extend([known[word] for word in words[1:]])
        except KeyError:
            if len(known) > self.KEEP:
                known.clear()
            del out[1:]
            for word in words[1:]:
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = self.whole(" " + word)
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return self._bpe.decode(ids.tolist())


class Capacities:
    """Which free capacities have an open row: a segment tree over 0..size.

    Each node says whether any capacity below it is taken. The least sufficient
    capacity is found by going up from a leaf and down again, in log(size) steps.
    """

    def __init__(self, size: int):
        self._leaves = 1 << size.bit_length()
        self._any = [0] * (2 * self._leaves)
        self._rows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, row: int) -> None:
        self._rows[capacity].append(row)
        self._count(capacity, 1)

    def _count(self, capacity: int, step: int) -> None:
        node = capacity + self._leaves
        while node:
            self._any[node] += step
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Row with the least capacity of at least ``need``, and that capacity."""
        node, tree = need + self._leaves, self._any
        if not tree[node]:
            while True:
                if node & 1 == 0 and tree[node + 1]:
                    node += 1
                    break
                node >>= 1
                if node <= 1:
                    return None
            while node < self._leaves:
                node *= 2
                if not tree[node]:
                    node += 1
        capacity = node - self._leaves
        row = self._rows[capacity].pop()
        self._count(capacity, -1)
        return row, capacity


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Row of each piece, and number of rows; pieces are not longer than ``size``."""
    rows = np.empty(len(lengths), np.int64)
    free, n = Capacities(size), 0
    order = np.argsort(-lengths, kind="stable")
    for piece, need in zip(order.tolist(), lengths[order].tolist()):
        if need == size:
            row, left = n, 0
            n += 1
        else:
            found = free.take(need)
            row, capacity = found or (n, size)
            n += found is None
            left = capacity - need
        rows[piece] = row
        if left:
            free.put(left, row)
    return rows, n


def pack(ids: list[bytes], doc_ids: list[int | None], size: int, shard: str, pad: int) -> Iterator[dict]:
    """Matrices of the documents' ids.

    A document longer than a row is cut into pieces of a row each and a rest;
    ``doc_starts`` says where in its document each segment begins.
    """
    tokens = np.frombuffer(b"".join(ids), np.uint16)
    sizes = np.array([len(x) // 2 for x in ids], np.int64)
    begin = np.cumsum(sizes) - sizes
    pieces = -(-sizes // size)
    doc = np.repeat(np.arange(len(ids)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    inside = nth * size
    length = np.minimum(sizes[doc] - inside, size)
    row, n = best_fit_decreasing(length, size)
    order = np.argsort(row, kind="stable")
    row, doc, inside, length = row[order], doc[order], inside[order], length[order]
    source = begin[doc] + inside
    for at in range(0, n, BLOCK_ROWS):
        rows = min(BLOCK_ROWS, n - at)
        a, z = np.searchsorted(row, [at, at + rows])
        matrix = np.full(rows * size, pad, np.uint16)
        places = np.zeros(rows * size, np.uint16)
        cuts, owners, starts = [0], [], []
        for r in range(rows):
            b, e = np.searchsorted(row[a:z], [at + r, at + r + 1]) + a
            fill = r * size
            for k in range(b, e):
                step = int(length[k])
                matrix[fill : fill + step] = tokens[source[k] : source[k] + step]
                places[fill : fill + step] = np.arange(step)
                fill += step
                cuts.append(fill)
                owners.append(doc_ids[doc[k]])
                starts.append(int(inside[k]))
            if fill < (r + 1) * size:  # the padding is a segment without a document
                places[fill : (r + 1) * size] = np.arange((r + 1) * size - fill)
                cuts.append((r + 1) * size)
                owners.append(None)
                starts.append(-1)
        yield {
            "shard": shard,
            "block": at // BLOCK_ROWS,
            "n_rows": rows,
            "row_tokens": size,
            "ids": matrix.tobytes(),
            "positions": places.tobytes(),
            "cu_seqlens": cuts,
            "doc_ids": owners,
            "doc_starts": starts,
        }


def _arrow_schema() -> pa.Schema:
    return pa.schema(
        [
            ("shard", pa.string()), ("block", pa.int32()), ("n_rows", pa.int32()),
            ("row_tokens", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary()),
            ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())),
            ("doc_starts", pa.list_(pa.int64())),
        ]
    )


def pack_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_tokens: int = ROW,
    vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}",
    end: int = END,
) -> DataFrame:
    """Packed matrices of token ids of all documents.

    Each text becomes its ids and one end id. A record is a block of rows of
    ``row_tokens`` ids: ``ids`` and ``positions`` are matrices of little-endian
    16-bit numbers, ``cu_seqlens`` are the cumulative lengths of the segments in the
    flattened matrix, ``doc_ids`` and ``doc_starts`` say which document a segment
    comes from and at which of its tokens it begins. Positions start anew in each
    segment. Padding is a segment of end ids with a null document and start -1.

    Rows are filled by best fit, longest piece first. Documents that are packed
    together come from one input split and are at most ``SHARD_TOKENS`` ids (or one
    document), so nothing is shuffled and a task's memory has a bound; the last rows
    of a shard are the only ones that may stay part empty.

    Null and empty texts give a segment with the end id alone. Repeated rows are
    packed as often as they occur; segments of a null id have start 0 or more.
    Empty tables give no records. Other columns are not read.
    """
    if not 0 < row_tokens <= 1 << 16:
        raise ValueError("a row has 1 to 65,536 tokens")
    spark: SparkSession = docs.sparkSession
    held = spark.sparkContext.broadcast(read_bytes(vocabulary))
    schema = _arrow_schema()
    end_bytes = np.uint16(end).tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder(held.value)
        part, number = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        owners: list[int | None] = []
        amount = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found: list[dict] = []
            for block in pack(ids, owners, row_tokens, f"{part:06d}-{number:04d}", end):
                found.append(block)
                if len(found) == 16:
                    yield pa.RecordBatch.from_pylist(found, schema)
                    found = []
            if found:
                yield pa.RecordBatch.from_pylist(found, schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(encoder.encode(text or "") + end_bytes)
                owners.append(doc_id)
                amount += len(ids[-1]) // 2
                if amount >= SHARD_TOKENS:
                    yield from flush()
                    ids, owners, amount, number = [], [], 0, number + 1
        if ids:
            yield from flush()

    chosen = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    return chosen.mapInArrow(task, SCHEMA)
