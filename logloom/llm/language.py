"""Language identification with bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import frugal, mix, slices, small_batches, stored, text_buffer, without

UNDETERMINED = "und"
#: Bytes of an n-gram (lower-case ASCII letters; bytes beyond ASCII as they are).
WIDTHS = (3, 4, 5)
#: Documents per language that the filters are learned from, about; chosen by hash.
SAMPLE = 4000
#: n-grams kept per language at most, the most frequent first.
GRAMS = 1 << 15
#: Positions of the filter; each holds one bit per language, 64 of them in a word.
POSITIONS = 1 << 21
HASHES = 2
#: An n-gram belongs to each language where it is at least this frequent, relative to where it is most.
SHARE = 0.4
RESULT = ("lang_pred", "score")

#: Counts of n-grams that a task holds at most, over all languages; more go on in parts.
HELD = 1 << 20

Counts = tuple[np.ndarray, np.ndarray]
_SLICE = 1 << 18
_SPACE = 0x20
#: ASCII letters in lower case, other ASCII signs as one space, bytes beyond ASCII as they are.
_FOLD = np.full(256, _SPACE, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _grams(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams as numbers and the documents they are in; runs of spaces count as one space."""
    folded = _FOLD[data]
    space = folded == _SPACE
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[starts[:-1][starts[:-1] < len(folded)]] = True
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[keep]
    folded = folded[keep].astype(np.uint64)
    n = len(folded) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.full(n, width, np.uint64)
    for k in range(width):
        value = (value << np.uint64(8)) | folded[k : k + n]
    whole = owner[:n] == owner[width - 1 :]
    return value[whole], owner[:n][whole]


def _merged(parts: list[Counts]) -> Counts:
    """Different n-grams, and how often each occurs in all parts."""
    values, place = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    n = np.zeros(len(values), np.int64)
    np.add.at(n, place, np.concatenate([c for _, c in parts]))
    return values, n


def _rows_of(name: str, parts: list[Counts]) -> pa.RecordBatch:
    values, n = _merged(parts)
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(values)), pa.array(values.astype(np.int64)), pa.array(n)],
        ["lang", "gram", "n"],
    )


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each n-gram occurs in texts of each language, in one part or several."""
    held: dict[str, list[Counts]] = {}
    size = 0
    for batch in batches:
        names = np.array(batch.column(1).to_pylist(), object)
        for name in set(names.tolist()):
            data, starts = text_buffer(batch.column(0).filter(pa.array(names == name)))
            for a, z in slices(starts, _SLICE):
                cut = starts[a : z + 1]
                for width in WIDTHS:
                    grams = _grams(data[cut[0] : cut[-1]], cut - cut[0], width)[0]
                    held.setdefault(name, []).append(np.unique(grams, return_counts=True))
                    size += len(held[name][-1][0])
                if size > HELD:
                    held = {k: [_merged(parts)] for k, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > HELD // 2:
                        yield from map(_rows_of, held, held.values())
                        held, size = {}, 0
    yield from map(_rows_of, held, held.values())


@dataclass(frozen=True)
class LanguageFilter:
    """For each position of the filter a mask of languages, in as many rows of words as they need."""

    languages: tuple[str, ...]
    masks: np.ndarray
    false_rate: np.ndarray
    prior: np.ndarray

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """Mask of all languages that hold each n-gram, a row per word of the mask."""
        found = None
        for k in range(HASHES):
            at = _position(grams, k)
            own = self.masks[:, at]
            found = own if found is None else found & own
        return found

    def counts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """n-grams per document and language, less those expected by accident."""
        docs, n = len(starts) - 1, len(self.languages)
        hits, total = np.zeros((docs, n)), np.zeros(docs)
        for width in WIDTHS:
            grams, owner = _grams(data, starts, width)
            if not len(grams):
                continue
            total += np.bincount(owner, minlength=docs)
            found = self.lookup(grams)
            for k in range(n):
                bit = (found[k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                hits[:, k] += np.bincount(owner, weights=bit, minlength=docs)
        expected = total[:, None] * self.false_rate[None, :]
        return np.maximum(0.0, (hits - expected) / (1 - self.false_rate)[None, :])

    def decide(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language of each document and its share of the counts.

        Ties go to the language with more training documents, then to the lesser name.
        """
        counts = self.counts(data, starts)
        rank = np.lexsort((np.arange(len(self.languages)), -self.prior))
        best = rank[np.argmax(counts[:, rank], axis=1)]
        total = counts.sum(axis=1)
        score = np.divide(
            counts[np.arange(len(best)), best], total, out=np.zeros(len(best)), where=total > 0
        )
        return best, score


def _position(grams: np.ndarray, k: int) -> np.ndarray:
    return (mix(grams + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) % np.uint64(POSITIONS)).astype(np.int64)


def _sampled(labelled: DataFrame, size: int) -> DataFrame:
    """About ``size`` documents of each language, by hash of the text."""
    per = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    drawn = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.join(F.broadcast(per), "lang").where(drawn < F.lit(size) / F.col("_n"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageFilter:
    """Filters of the labelled ``docs``; rows with null text or language are left out.

    About ``sample`` documents per language are counted (a documented bound). All
    languages are learned, however many; a filter has 16 MB per 64 of them.
    """
    labelled = small_batches(docs).select(docs[text_col].alias("text"), docs[lang_col].alias("lang")).dropna()
    prior = {
        r["lang"]: r["n"]
        for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    languages = tuple(sorted(prior))

    grams = _sampled(labelled, sample).select("text", "lang").mapInArrow(frugal(_count_grams), "lang string, gram bigint, n bigint")
    # Occurrences of an n-gram by language: a row per n-gram, of which only the frequent
    # ones are of use. The cut is the feature: a filter holds GRAMS n-grams a language.
    masks = np.zeros((-(-len(languages) // 64), POSITIONS), np.uint64)
    if languages:
        # Languages go by number: their names need not be good, or different, column names.
        own_counts = [f"n{k}" for k in range(len(languages))]
        counts = [
            F.sum(F.when(F.col("lang") == x, F.col("n"))).alias(c) for x, c in zip(languages, own_counts)
        ]
        wide = stored(grams.groupBy("gram").agg(*counts), "grams")
        totals = wide.agg(*[F.sum(c) for c in own_counts]).first()
        rates = [
            F.coalesce(F.col(c), F.lit(0)) / F.lit(float(totals[k] or 1)) for k, c in enumerate(own_counts)
        ]
        top = F.greatest(*rates) if len(rates) > 1 else rates[0]
        for k, c in enumerate(own_counts):
            own = wide.where(rates[k] >= F.lit(SHARE) * top).where(F.col(c) > 1)
            rows = own.orderBy(F.desc(c), "gram").limit(GRAMS).select("gram").toPandas()
            values = rows["gram"].to_numpy(np.int64).astype(np.uint64)
            for j in range(HASHES):
                masks[k // 64, _position(values, j)] |= np.uint64(1 << k % 64)
    fill = [float(((masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(languages))]
    return LanguageFilter(
        languages, masks, np.array(fill) ** HASHES, np.array([prior[x] for x in languages], np.float64)
    )


def identify(docs: DataFrame, filters: LanguageFilter, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1).

    Every n-gram of the whole text is looked up; the corrected count decides. ``und``
    with score 0 goes to null texts and texts without a letter. A text with letters
    but no known n-gram gets the most frequent training language with score 0; if
    nothing was learned, ``und``. Repeated rows are judged alike, empty tables give
    empty results, and input columns named like a result column are replaced.
    """
    docs = small_batches(without(docs, RESULT))
    if not filters.languages:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    held = docs.sparkSession.sparkContext.broadcast(filters)
    place = docs.columns.index(text_col)
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        names = pa.array([*known.languages, UNDETERMINED])
        plain = re.compile("[A-Za-z]")
        for batch in batches:
            data, starts = text_buffer(batch.column(place))
            for a, z in slices(starts, _SLICE):  # handed on slice by slice, so that little is held
                cut, part = starts[a : z + 1], batch.slice(a, z - a)
                best, score = known.decide(data[cut[0] : cut[-1]], cut - cut[0])
                # Most texts have an ASCII letter early on; only the others are read through.
                for i, text in enumerate(part.column(place).to_pylist()):
                    if text is None or not (plain.search(text) or any(map(str.isalpha, text))):
                        best[i], score[i] = len(known.languages), 0.0
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, names.take(pa.array(best)), pa.array(score)],
                    [*part.schema.names, "lang_pred", "score"],
                )

    return docs.mapInArrow(frugal(task), schema)
