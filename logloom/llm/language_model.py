"""Scores of texts under a word bigram model kept in Elias-Fano tries."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from logloom.llm.common import (
    LOWERED,
    WordHasher,
    parts_for,
    slices,
    stored,
    text_buffer,
    total_bytes,
    word_spans,
)

#: Absolute discount of seen bigrams.
DISCOUNT = 0.75
#: Bytes of text that are counted and scored together, and of text per shard of the model.
GROUP, SHARD = 16 << 20, 8 << 20
#: First words with a larger share of all tokens than this (or a quarter of a shard's, if that is
#: more) have their successors dealt over all shards; fewer than 100,000 words can be such.
HEAVY_SHARE = 1e-5
#: Bits of a word's hash that tell it from other successors of the same word.
NEXT_BITS = 43

_HASHER = WordHasher(4)
#: End of a text, and what its first word follows; hashes no word is likely to have.
END, START = np.uint64(2**64 - 59), np.uint64(2**64 - 83)
_SLICE = 1 << 21


# --- monotone sequences -----------------------------------------------------------


@dataclass
class Monotone:
    """A non-decreasing sequence in Elias-Fano form: low bytes as they are, high parts in unary."""

    n: int
    low_bytes: int
    upper: np.ndarray
    low: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Monotone:
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        wide = max(0, int(values[-1]).bit_length() - n.bit_length())
        low_bytes = min(7, -(-wide // 8))
        shift = np.uint64(8 * low_bytes)
        places = (values >> shift).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        low = np.ascontiguousarray(values).view(np.uint8).reshape(n, 8)[:, :low_bytes]
        return cls(n, low_bytes, np.packbits(bits), np.ascontiguousarray(low).ravel())

    def dump(self) -> bytes:
        head = np.array([self.n, self.low_bytes, len(self.upper), len(self.low)], np.int64)
        return head.tobytes() + self.upper.tobytes() + self.low.tobytes()

    def open(self) -> Monotone:
        """Set up the directory: where the values of each high part begin."""
        ones = np.flatnonzero(np.unpackbits(self.upper))
        self._high = ones - np.arange(len(ones))
        top = int(self._high[-1]) + 1 if self.n else 0
        self._first = np.searchsorted(self._high, np.arange(top + 1))
        self._rows = self.low.reshape(self.n, self.low_bytes) if self.low_bytes else None
        return self

    def _low_of(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 8), np.uint8)
        if self._rows is not None:
            out[:, : self.low_bytes] = self._rows[at]
        return out.view(np.uint64).ravel()

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self._high[at].astype(np.uint64) << np.uint64(8 * self.low_bytes)) | self._low_of(at)

    def successor(self, wanted: np.ndarray) -> np.ndarray:
        """Place of the first value not less than each wanted one; n if there is none."""
        if not self.n:
            return np.zeros(len(wanted), np.int64)
        shift = np.uint64(8 * self.low_bytes)
        high = np.minimum((wanted >> shift), np.uint64(len(self._first) - 1)).astype(np.int64)
        beyond = (wanted >> shift) >= np.uint64(len(self._first) - 1)
        low = wanted & ((np.uint64(1) << shift) - np.uint64(1))
        a = self._first[high]
        z = self._first[np.minimum(high + 1, len(self._first) - 1)]
        a, z = a.copy(), z.copy()
        while (open_ := a < z).any():
            mid = (a + z) >> 1
            less = np.zeros(len(a), bool)
            less[open_] = self._low_of(mid[open_]) < low[open_]
            a = np.where(open_ & less, mid + 1, a)
            z = np.where(open_ & ~less, mid, z)
        return np.where(beyond, self.n, a)


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes 1 to 255 and the mean of each code's values; code 0 is kept for nothing."""
    book = np.zeros(256, np.float32)
    if not len(values):
        return np.zeros(0, np.uint8), book
    kinds, inverse, n = np.unique(values, return_inverse=True, return_counts=True)
    if len(kinds) <= 255:
        book[1 : len(kinds) + 1] = kinds
        return (inverse + 1).astype(np.uint8), book
    # Bins of one width, so that no value is off by more than half of it.
    width = (kinds[-1] - kinds[0]) / 255
    bins = np.minimum(((kinds - kinds[0]) / width).astype(np.int64), 254)
    weight = np.bincount(bins, weights=n, minlength=255)
    book[1:] = np.bincount(bins, weights=kinds * n, minlength=255) / np.maximum(weight, 1)
    return (bins[inverse] + 1).astype(np.uint8), book


@dataclass
class Trie:
    """One shard: words, and for each the words that follow it, as compact levels.

    ``words`` are hashes relative to the shard's first possible one; ``totals`` are
    running counts; ``pointers`` say where the successors of a word begin; ``after``
    holds, for all words in turn, the successors as (place of the word, hash of the
    successor), so that it ascends over the whole level.
    """

    base: int
    words: Monotone
    totals: Monotone
    pointers: Monotone
    after: Monotone
    seen: np.ndarray
    seen_book: np.ndarray
    back: np.ndarray
    back_book: np.ndarray

    @staticmethod
    def build(
        base: int, words: np.ndarray, counts: np.ndarray, per_word: np.ndarray, after: np.ndarray,
        after_counts: np.ndarray, heavy: np.ndarray,
    ) -> bytes:
        """Levels of trained words and bigrams; those of ``heavy`` words are weighed without their totals."""
        place = np.repeat(np.arange(len(words), dtype=np.uint64), per_word)
        total = np.where(heavy, 1, counts)[place.astype(np.int64)]
        seen, seen_book = quantised(np.log10((after_counts - DISCOUNT) / np.maximum(total, 1)))
        weight = DISCOUNT * per_word / np.maximum(counts, 1)
        known = (per_word > 0) & ~heavy
        back = np.zeros(len(words), np.uint8)
        back[known], back_book = quantised(np.log10(weight[known]))
        levels = [
            Monotone.of(words - np.uint64(base)),
            Monotone.of(np.cumsum(np.concatenate(([0], counts))).astype(np.uint64)),
            Monotone.of(np.cumsum(np.concatenate(([0], per_word))).astype(np.uint64)),
            Monotone.of((place << np.uint64(NEXT_BITS)) | after),
        ]
        tail = seen_book.tobytes() + back_book.tobytes() + back.tobytes() + seen.tobytes()
        return np.array([base], np.uint64).tobytes() + b"".join(x.dump() for x in levels) + tail

    @classmethod
    def map(cls, data: np.ndarray) -> Trie:
        base, at = int(data[:8].view(np.uint64)[0]), 8
        levels = []
        for _ in range(4):
            # Headers may stand at any byte, hence the copy of their few numbers.
            head = np.frombuffer(data[at : at + 32].tobytes(), np.int64).tolist()
            n, low_bytes, upper, low = head
            at += 32
            levels.append(Monotone(n, low_bytes, data[at : at + upper], data[at + upper : at + upper + low]).open())
            at += upper + low
        books = np.frombuffer(data[at : at + 2048].tobytes(), np.float32)
        at += 2048
        n = levels[0].n
        return cls(base, *levels, data[at + n :], books[:256], data[at : at + n], books[256:])

    def find(self, words: np.ndarray) -> np.ndarray:
        """Place of each word, -1 if unknown."""
        wanted = words - np.uint64(self.base)
        at = self.words.successor(wanted)
        safe = np.minimum(at, max(self.words.n - 1, 0))
        same = self.words[safe] == wanted if self.words.n else np.zeros(len(words), bool)
        return np.where((at < self.words.n) & same, at, -1)

    def counts(self, place: np.ndarray) -> np.ndarray:
        own = np.maximum(place, 0)
        if not self.words.n:
            return np.zeros(len(place), np.int64)
        return np.where(place >= 0, (self.totals[own + 1] - self.totals[own]).astype(np.int64), 0)

    def seen_codes(self, place: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Code of each bigram: the successor is searched among those of the word at ``place``."""
        out = np.zeros(len(place), np.uint8)
        known = np.flatnonzero(place >= 0)
        if not len(known) or not self.after.n:
            return out
        own = place[known]
        key = (own.astype(np.uint64) << np.uint64(NEXT_BITS)) | after[known]
        at = self.after.successor(key)
        inside = at < self.pointers[own + 1].astype(np.int64)
        hit = np.flatnonzero(inside)
        hit = hit[self.after[at[hit]] == key[hit]]
        out[known[hit]] = self.seen[at[hit]]
        return out

    def back_codes(self, place: np.ndarray) -> np.ndarray:
        if not self.words.n:
            return np.zeros(len(place), np.uint8)
        return np.where(place >= 0, self.back[np.maximum(place, 0)], 0).astype(np.uint8)


# --- tokens of a group ------------------------------------------------------------


@dataclass
class Tokens:
    """Tokens of some documents: distinct words by hash, distinct bigrams by words."""

    words: np.ndarray
    word: np.ndarray
    sizes: np.ndarray
    firsts: np.ndarray
    pair: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray) -> Tokens:
        hashes, counts = [], []
        for a, z in slices(starts, _SLICE):
            cut = starts[a : z + 1]
            mapped, begin, end, n = word_spans(data[cut[0] : cut[-1]], cut - cut[0], LOWERED)
            hashes.append(_HASHER.words(mapped, begin, end))
            counts.append(n)
        own = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        sizes = n + 1
        firsts = np.cumsum(sizes) - sizes
        tokens = np.full(len(own) + len(n), END, np.uint64)
        inside = np.ones(len(tokens), bool)
        inside[firsts + n] = False
        tokens[inside] = own
        words, word = np.unique(np.append(tokens, START), return_inverse=True)
        start, word = word[-1], word[:-1]
        before = np.empty(len(word), np.int64)
        before[1:] = word[:-1]
        before[firsts] = start
        return cls(words, word, sizes, firsts, before * len(words) + word)

    def trained(self, train: np.ndarray) -> np.ndarray:
        """Whether each token is in a training document."""
        return np.repeat(train, self.sizes)


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _base_of(shard: int, shards: int) -> int:
    """No word of the shard has a lesser hash."""
    return -(-(shard << 32) // shards) << 32


def _routes(tokens: Tokens, pairs: np.ndarray, heavy: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each distinct word and of each distinct pair.

    A pair goes with its first word, or by its second one if the first is heavy.
    """
    n = len(tokens.words)
    home = _shard_of(tokens.words, shards)
    first, second = pairs // n, pairs % n
    spread = np.isin(tokens.words, heavy)[first]
    return home, np.where(spread, home[second], home[first])


def _six(values: np.ndarray) -> np.ndarray:
    """The upper six bytes of each hash."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, 2:]).ravel()


def _from_six(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = data.reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _small(counts: np.ndarray) -> bytes:
    """Counts as single bytes, and the large ones besides."""
    large = np.flatnonzero(counts > 254)
    small = np.minimum(counts, 255).astype(np.uint8)
    head = np.array([len(counts), len(large)], np.int64)
    return head.tobytes() + counts[large].astype(np.int64).tobytes() + small.tobytes()


def _read_small(data: memoryview, at: int) -> tuple[np.ndarray, int]:
    n, large = np.frombuffer(data, np.int64, 2, at).tolist()
    big = np.frombuffer(data, np.int64, large, at + 16)
    out = np.frombuffer(data, np.uint8, n, at + 16 + 8 * large).astype(np.int64)
    out[out == 255] = big
    return out, at + 16 + 8 * large + n


@dataclass
class Asked:
    """What a group asks of a shard: words with their counts, and pairs by the place of their first word."""

    words: np.ndarray
    counts: np.ndarray
    per_word: np.ndarray
    after: np.ndarray
    after_counts: np.ndarray

    def dump(self) -> bytes:
        head = np.array([len(self.words), len(self.after)], np.int64)
        return b"".join([
            head.tobytes(), self.words.tobytes(), _six(self.after).tobytes(),
            _small(self.counts), _small(self.per_word), _small(self.after_counts),
        ])

    @classmethod
    def load(cls, data: bytes) -> Asked:
        view = memoryview(data)
        n, pairs = np.frombuffer(view, np.int64, 2).tolist()
        words = np.frombuffer(view, np.uint64, n, 16)
        after = _from_six(np.frombuffer(view, np.uint8, 6 * pairs, 16 + 8 * n))
        counts, at = _read_small(view, 16 + 8 * n + 6 * pairs)
        per_word, at = _read_small(view, at)
        after_counts, _ = _read_small(view, at)
        return cls(words, counts, per_word, after, after_counts)


def _asks(tokens: Tokens, train: np.ndarray | None, heavy: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, Asked]]:
    """Per shard: places of its words and pairs, and the message; counts are 0 without ``train``."""
    n = len(tokens.words)
    pairs, pair = np.unique(tokens.pair, return_inverse=True)
    tokens.pair = pair
    if train is None:
        counts, pair_counts = np.zeros(n, np.int64), np.zeros(len(pairs), np.int64)
    else:
        own = tokens.trained(train)
        counts = np.bincount(tokens.word[own], minlength=n)
        pair_counts = np.bincount(pair[own], minlength=len(pairs))
        counts[tokens.words == START] = int(train.sum())
    home, route = _routes(tokens, pairs, heavy, shards)
    first, second = pairs // n, pairs % n
    by_word, by_pair = np.argsort(home, kind="stable"), np.argsort(route, kind="stable")
    every = np.union1d(home, route)
    sorted_home, sorted_route = home[by_word], route[by_pair]
    for shard in every.tolist():
        w = by_word[slice(*np.searchsorted(sorted_home, [shard, shard + 1]))]
        p = by_pair[slice(*np.searchsorted(sorted_route, [shard, shard + 1]))]
        guests = np.setdiff1d(first[p], w)  # heavy words that live elsewhere
        all_words = np.sort(np.concatenate((w, guests)))
        at_home = home[all_words] == shard
        per_word = np.bincount(np.searchsorted(all_words, first[p]), minlength=len(all_words))
        message = Asked(
            tokens.words[all_words], np.where(at_home, counts[all_words], 0), per_word, tokens.words[second[p]], pair_counts[p]
        )
        yield shard, all_words, p, message


# --- answers of a shard -----------------------------------------------------------


def _answered(shard: int, shards: int, asked: list[tuple[int, bytes]], heavy: np.ndarray) -> Iterator[tuple[int, int, bytes, int, int, int]]:
    """Train the shard on all that is asked, and answer each group from the mapped trie.

    Rows: group, shard, answer, tokens, distinct words, successors of a heavy word
    (then the word in place of the group's answer).
    """
    parts = [Asked.load(data) for _, data in asked]
    words, inverse = np.unique(np.concatenate([p.words for p in parts]), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([p.counts for p in parts]), minlength=len(words)).astype(np.int64)
    firsts = np.repeat(inverse, np.concatenate([p.per_word for p in parts]))
    after = np.concatenate([p.after for p in parts]) >> np.uint64(64 - NEXT_BITS)
    amount = np.concatenate([p.after_counts for p in parts])
    order = np.lexsort((after, firsts))
    order = order[amount[order] > 0]
    firsts, after, amount = firsts[order], after[order], amount[order]
    new = np.ones(len(firsts), bool)
    new[1:] = (firsts[1:] != firsts[:-1]) | (after[1:] != after[:-1])
    begin = np.flatnonzero(new)
    amount = np.add.reduceat(amount, begin) if len(begin) else amount
    per_word = np.bincount(firsts[begin], minlength=len(words))
    kept = (counts > 0) | (per_word > 0)
    is_heavy = np.isin(words, heavy)
    # Frequent words may come from other shards.
    base = min(_base_of(shard, shards), int(words[0]))
    data = Trie.build(base, words[kept], counts[kept], per_word[kept], after[begin], amount, is_heavy[kept])
    real = (words != START) & (counts > 0)
    yield -1, shard, b"", int(counts[real].sum()), int(real.sum()), 0
    for k in np.flatnonzero(is_heavy & (per_word > 0)).tolist():
        yield -2, shard, words[k].tobytes(), 0, 0, int(per_word[k])
    with tempfile.NamedTemporaryFile(prefix="trie-") as file:
        file.write(data)
        file.flush()
        del data
        trie = Trie.map(np.memmap(file.name, np.uint8, "r"))
        for (group, _), part in zip(asked, parts):
            place = trie.find(part.words)
            seen = trie.seen_codes(np.repeat(place, part.per_word), part.after >> np.uint64(64 - NEXT_BITS))
            answer = b"".join([
                trie.seen_book.tobytes(), trie.back_book.tobytes(),
                _small(trie.counts(place)), trie.back_codes(place).tobytes(), seen.tobytes(),
            ])
            yield group, shard, answer, 0, 0, 0


def _read_answer(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and log weights of the words' unseen successors (1 = none known), log probabilities of pairs (1 = unseen)."""
    view = memoryview(data)
    seen_book = np.frombuffer(view, np.float32, 256).astype(np.float64)
    back_book = np.frombuffer(view, np.float32, 256, 1024).astype(np.float64)
    counts, at = _read_small(view, 2048)
    back = np.frombuffer(view, np.uint8, len(counts), at)
    seen = np.frombuffer(view, np.uint8, -1, at + len(counts))
    return counts, np.where(back > 0, back_book[back], 1.0), np.where(seen > 0, seen_book[seen], 1e9)


# --- the corpus -------------------------------------------------------------------

_PACKED = "group int, kind int, ids array<{kind}>, train array<boolean>, sizes binary, data binary"


def _packed(docs: DataFrame, groups: int) -> DataFrame:
    """Documents of a batch by group, their texts compressed together."""
    kind = docs.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, starts = text_buffer(batch.column(1))
            group = batch.column(3).to_numpy(zero_copy_only=False)
            order = np.argsort(group, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(order))
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = order[a:z]
                size = (starts[own + 1] - starts[own]).astype(np.int64)
                text = b"".join([data[starts[i] : starts[i + 1]].tobytes() for i in own.tolist()])
                picked = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([group[order[a]]], pa.int32()), pa.array([1], pa.int32()),
                        pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), batch.column(0).take(picked)),
                        pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), batch.column(2).take(picked)),
                        pa.array([size.tobytes()], pa.binary()), pa.array([press.compress(text)], pa.binary()),
                    ],
                    ["group", "kind", "ids", "train", "sizes", "data"],
                )

    return docs.mapInArrow(task, _PACKED.format(kind=kind))


def _unpacked(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Text bytes and starts of packed rows (sizes, data)."""
    open_ = zstandard.ZstdDecompressor()
    sizes = np.concatenate([np.frombuffer(s, np.int64) for s, _ in rows])
    text = b"".join([open_.decompress(d, max_output_size=max(1, int(np.frombuffer(s, np.int64).sum()))) for s, d in rows])
    return np.frombuffer(text, np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def _heavy_words(texts: DataFrame, shards: int) -> np.ndarray:
    """Words with so many tokens that one shard should not hold all their successors."""
    share = max(HEAVY_SHARE, 1 / (4 * shards))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffer(batch.column(0))
            # Whichever word is that frequent overall is so in some part of the texts.
            for a, z in slices(starts, GROUP):
                cut = starts[a : z + 1]
                mapped, begin, end, n = word_spans(data[cut[0] : cut[-1]], cut - cut[0], LOWERED)
                own, count = np.unique(_HASHER.words(mapped, begin, end), return_counts=True)
                total = len(begin) + len(n)
                often = count > total * share
                values = np.concatenate((own[often], [START, START]))
                count = np.concatenate((count[often], [len(n), 0]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), pa.array(count), pa.array([0] * (len(count) - 1) + [total])], ["word", "n", "total"]
                )

    found = texts.mapInArrow(task, "word bigint, n bigint, total bigint")
    sums = stored(found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "frequent")
    total = sums.agg(F.sum("total")).first()[0] or 0
    rows = sums.where(F.col("n") > total * share).select("word").collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


def score(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text (runs of signs other than ASCII white space, A-Z
    in lower case) and an end. The model learns from all rows where ``train`` is true:

        p(w | v) = max(c(v w) - D, 0) / c(v) + D t(v) / c(v) p(w),  p(w) = (c(w) + 1) / (N + V + 1)

    with t(v) distinct successors of v; p(w | v) = p(w) for a v without any. ``score``
    is the log10 probability of the text, ``base_score`` that under p(w) alone, both
    over all tokens. Bigram weights are quantised to 8 bits, counts are exact.

    Documents are dealt into groups by hash. A group asks shards about its distinct
    words and bigrams, and the same message carries its training counts; a shard
    trains its trie, memory-maps it, and answers each group; groups score their
    texts. So counts grow with the corpus, yet no task holds more than one group or
    shard, and nothing but totals comes to the driver. The successors of frequent
    words are dealt over all shards.

    Null, empty and blank texts are a single end. A null ``train`` counts as false.
    Repeated rows count and score each on their own. Empty tables give empty results.
    Other columns are not read.
    """
    spark = docs.sparkSession
    chosen = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    total = total_bytes(chosen)
    groups, shards = parts_for(total, GROUP), parts_for(total, SHARD)
    heavy = _heavy_words(chosen.select("text"), shards)
    grouped = chosen.withColumn("group", F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("int"))
    packed = _packed(grouped, groups)

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
        current, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                if row[0] != current:
                    if held:
                        yield current, held
                    current, held = row[0], []
                held.append(row)
        if held:
            yield current, held

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in by_group(batches):
            data, starts = _unpacked([r[4:6] for r in rows])
            tokens = Tokens.of(data, starts)
            learned = np.array([t for r in rows for t in r[3]], bool)
            for shard, _, _, message in _asks(tokens, learned, heavy, shards):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([group], pa.int32()), pa.array([message.dump()], pa.binary())],
                    ["shard", "group", "data"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for shard, rows in by_group(batches):
            for row in _answered(shard, shards, [r[1:] for r in rows], heavy):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], k) for x, k in zip(row, kinds)], ["group", "shard", "data", "tokens", "words", "after"]
                )

    met = packed.repartition(groups, "group").sortWithinPartitions("group")
    messages = met.mapInArrow(ask, "shard int, group int, data binary")
    sent = messages.repartition(shards, "shard").sortWithinPartitions("shard", "group")
    answers = stored(
        sent.mapInArrow(answer, "group int, shard int, data binary, tokens bigint, words bigint, after bigint"), "answers"
    )
    sums = answers.where("group = -1").agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).first()
    n_train, n_words = sums["n"] or 0, sums["v"] or 0
    spread = answers.where("group = -2").groupBy("data").agg(F.sum("after").alias("t")).collect()
    successors = {int(np.frombuffer(r["data"], np.uint64)[0]): r["t"] for r in spread}
    kind = chosen.schema["id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = math.log10(n_train + n_words + 1)
        for _, rows in by_group(batches):
            texts = [r for r in rows if r[1] == 1]
            replies = {r[6]: r[5] for r in rows if r[1] == 0}
            data, starts = _unpacked([r[4:6] for r in texts])
            tokens = Tokens.of(data, starts)
            counts = np.zeros(len(tokens.words), np.int64)
            back = np.full(len(tokens.words), 1.0)
            seen = None
            first = tokens.pair // len(tokens.words)
            for shard, own, pairs, _ in _asks(tokens, None, heavy, shards):
                if seen is None:
                    seen = np.full(int(tokens.pair.max()) + 1, 1e9)
                n, weight, chance = _read_answer(replies[shard])
                home = _shard_of(tokens.words[own], shards) == shard
                counts[own[home]], back[own[home]] = n[home], weight[home]
                seen[pairs] = chance
            for place in np.flatnonzero(np.isin(tokens.words, heavy)).tolist():
                t = successors.get(int(tokens.words[place]), 0)
                if t and counts[place]:
                    back[place] = math.log10(DISCOUNT * t / counts[place])
            chance = np.log10(counts + 1.0) - floor
            base = chance[tokens.word]
            weight = back[first]
            # Weights of frequent words were stored without their totals.
            own_seen = seen[tokens.pair]
            is_heavy = np.isin(tokens.words, heavy)[first]
            own_seen = np.where(is_heavy & (own_seen < 1e8), own_seen - np.log10(np.maximum(counts[first], 1)), own_seen)
            fresh = weight >= 1.0
            mass = np.where(fresh, 1.0, 10.0 ** np.minimum(weight, 0.0)) * 10.0**base
            direct = np.where((own_seen < 1e8) & ~fresh, 10.0 ** np.minimum(own_seen, 0.0), 0.0)
            full = np.log10(np.minimum(direct + mass, 1.0))
            known = np.add.reduceat((counts[tokens.word] > 0).astype(np.int64), tokens.firsts)
            ids = [i for r in texts for i in r[2]]
            learned = [t for r in texts for t in r[3]]
            at = ids_type[0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, at), pa.array([not t for t in learned]), pa.array(tokens.sizes), pa.array(known),
                    pa.array(np.full(len(ids), n_train)), pa.array(np.add.reduceat(base, tokens.firsts)),
                    pa.array(np.add.reduceat(full, tokens.firsts)),
                ],
                ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    ids_type = [to_arrow_type(chosen.schema["id"].dataType)]
    replies = answers.where("group >= 0").select("group", F.lit(0).alias("kind"), "shard", "data")
    both = packed.unionByName(replies, allowMissingColumns=True)
    back_together = both.repartition(groups, "group").sortWithinPartitions("group", "kind", "shard")
    scored = back_together.select("group", "kind", "ids", "train", "sizes", "data", "shard").mapInArrow(
        judge,
        f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
    return scored.withColumnRenamed("id", id_col)
