"""Toxicity by a factorization machine: weights of hashed terms and of their pairs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import ALNUM, WordHasher, mix, parts_for, slices, small_batches, stored, text_buffer, without, word_spans

#: Bounds of what is fitted: labelled documents, hashed terms (the most frequent ones),
#: documents a term must be in, factors per term.
SAMPLE, TERMS, LEAST_DOCUMENTS, FACTORS = 20_000, 1 << 16, 20, 8
#: Parts of the sample that are fitted side by side, rounds in which their models are
#: averaged, and passes over a part within a round.
SHARDS, ROUNDS, PASSES = 4, 6, 2
#: Examples a step, step size, and decay of weights and factors.
STEP, RATE, DECAY = 64, 0.1, 1e-3
#: A word also counts by its beginnings of so many bytes, which inflected forms share.
STEMS = (4, 6)
#: A passage is two blocks of so many words; the next one begins a block later.
BLOCK = 128
RESULT = ("score", "predicted")

_SLICE = 1 << 20
_HASHER = WordHasher(11)


class Machine(NamedTuple):
    """Hashed terms in order; bias, weight and factors per term."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, index: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Log odds of ``n`` passages, given the distinct terms of each in order of passages."""
        out = np.full(n, self.bias)
        if len(index):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            v = self.factors[index]
            total = np.add.reduceat(v, first, axis=0)
            squares = np.add.reduceat((v * v).sum(axis=1), first)
            pairs = 0.5 * ((total * total).sum(axis=1) - squares)
            out[owner[first]] += np.add.reduceat(self.weights[index], first) + pairs
        return out

    def scores(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each document has the score of its most toxic passage."""
        hashes, counts = _hashed(data, starts)
        index, owner, passages = known_terms(hashes, counts, self.terms)
        z = self.margins(index, owner, int(passages.sum()))
        if len(z):
            z = np.maximum.reduceat(z, np.cumsum(passages) - passages)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _hashed(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of hashes of all words and one for each length of beginning, and words per document."""
    mapped, begin, end, counts = word_spans(data, starts, ALNUM)
    rows = [_HASHER.words(mapped, begin, end)]
    for k, size in enumerate(STEMS):
        stems = _HASHER.words(mapped, begin, np.minimum(end, begin + size))
        rows.append(np.where(end - begin >= size, mix(stems + np.uint64(k + 1)), 0))
    return np.stack(rows), counts


def known_terms(
    hashes: np.ndarray, counts: np.ndarray, terms: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``terms`` of the distinct terms of each passage, the passage of each, and passages per document.

    Every document has a passage; each word lies in the one or two that cover its block.
    """
    passages = np.maximum(-(-counts // BLOCK) - 1, 1)
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), passages
    doc = np.repeat(np.arange(len(counts)), counts)
    block = (np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc]) // BLOCK
    base = (np.cumsum(passages) - passages)[doc]
    first = base + np.maximum(block - 1, 0)
    last = base + np.minimum(block, passages[doc] - 1)
    found = []
    for row in hashes:
        at = np.minimum(np.searchsorted(terms, row), len(terms) - 1)
        hit = np.flatnonzero(terms[at] == row)
        found += [first[hit] * len(terms) + at[hit], last[hit] * len(terms) + at[hit]]
    both = np.unique(np.concatenate(found))
    return both % len(terms), both // len(terms), passages


def _step(
    index: np.ndarray,
    owner: np.ndarray,
    passages: np.ndarray,
    label: np.ndarray,
    model: dict[str, np.ndarray],
) -> None:
    """One step of gradient descent on the logistic loss, each weight at its own pace.

    A document counts with the passage that the model finds the most toxic.
    """
    machine = Machine(np.zeros(0), float(model["bias"][0]), model["weights"], model["factors"])
    z = machine.margins(index, owner, int(passages.sum()))
    begin = np.cumsum(passages) - passages
    doc = np.repeat(np.arange(len(passages)), passages)
    best = np.lexsort((np.arange(len(z)), -z, doc))[begin]
    z = z[best]
    number = np.full(len(doc), -1)
    number[best] = np.arange(len(best))
    taken = number[owner] >= 0
    index, owner = index[taken], number[owner[taken]]
    error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
    used, place = np.unique(index, return_inverse=True)
    v = model["factors"][index]
    total = np.zeros((len(label), v.shape[1]))
    if len(index):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        total[owner[first]] = np.add.reduceat(v, first, axis=0)
    order = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[order], prepend=-1))

    def summed(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[order], cuts, axis=0) if len(order) else values

    def move(name: str, at, gradient: np.ndarray) -> None:
        paces = model[f"{name} pace"]
        paces[at] += gradient**2
        model[name][at] -= RATE * gradient / np.sqrt(paces[at])

    n = len(label)
    e = error[owner]
    move("bias", slice(None), np.array([error.mean()]))
    if len(used):
        move("weights", used, summed(e) / n + DECAY * model["weights"][used])
        move("factors", used, summed(e[:, None] * (total[owner] - v)) / n + DECAY * model["factors"][used])


def _narrow(n: int) -> type:
    """Smallest type for places among ``n`` terms."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def _start(n: int, factors: int) -> dict[str, np.ndarray]:
    model = {
        "bias": np.zeros(1),
        "weights": np.zeros(n),
        "factors": np.random.default_rng(5).normal(0, 0.02, (n, factors)),
    }
    return model | {f"{k} pace": np.full(v.shape, 1e-6) for k, v in model.items()}


def _fitted(examples: DataFrame, n: int, factors: int, rounds: int, passes: int) -> dict[str, np.ndarray]:
    """Rounds of local passes over each shard, after which the shards' models are averaged.

    A model has a fixed size, and so have the shards of the bounded sample.
    """
    names = ["bias", "weights", "factors"]
    names += [f"{x} pace" for x in names]
    model = _start(n, factors)
    shapes = {k: v.shape for k, v in model.items()}
    spark = examples.sparkSession
    for turn in range(rounds):
        held = spark.sparkContext.broadcast({k: v.astype(np.float32) for k, v in model.items()})

        def task(batches: Iterator[pa.RecordBatch], turn: int = turn, held=held) -> Iterator[pa.RecordBatch]:
            own = {k: v.astype(np.float64) for k, v in held.value.items()}
            rows = [
                (label, np.frombuffer(sizes, np.int32), np.frombuffer(terms, _narrow(n)))
                for batch in batches
                for label, sizes, terms in zip(*(batch.column(x).to_pylist() for x in ("label", "sizes", "terms")))
            ]
            if not rows:
                return
            rng = np.random.default_rng(turn)
            for _ in range(passes):
                order = rng.permutation(len(rows))
                for a in range(0, len(order), STEP):
                    part = [rows[i] for i in order[a : a + STEP]]
                    passages = np.array([len(sizes) for _, sizes, _ in part], np.int64)
                    sizes = np.concatenate([sizes for _, sizes, _ in part])
                    index = np.concatenate([t for *_, t in part]).astype(np.int64)
                    owner = np.repeat(np.arange(len(sizes)), sizes)
                    _step(index, owner, passages, np.array([float(x) for x, *_ in part]), own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(rows)]), *(pa.array([own[k].astype(np.float32).tobytes()]) for k in names)],
                ["n", *(k.replace(" ", "_") for k in names)],
            )

        kinds = ", ".join(f"{k.replace(' ', '_')} binary" for k in names)
        local = examples.mapInArrow(task, f"n bigint, {kinds}").orderBy("n", "weights").collect()
        held.unpersist()
        total = sum(r["n"] for r in local)
        if not total:
            break
        for k in names:
            parts = [np.frombuffer(r[k.replace(" ", "_")], np.float32).astype(np.float64) * r["n"] for r in local]
            model[k] = (sum(parts) / total).reshape(shapes[k])
    return model


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    terms: int = TERMS,
    factors: int = FACTORS,
    rounds: int = ROUNDS,
    passes: int = PASSES,
) -> Machine:
    """Fit to the labelled ``docs``; rows with a null id, text or label are left out.

    The ``sample`` documents whose ids have the least hashes are fitted (a documented
    bound). An id with several labels is toxic if one says so; one that several rows
    share is left out, as its label may be that of any of them.
    Terms are words (letters, digits, signs beyond ASCII; A-Z in lower case) and their
    beginnings, hashed to 64 bits; a passage has a term or not. A document counts with its most toxic
    passage, in fitting as in scoring, so a long one is not drowned. Without labels every score is one half.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    marked = marked.groupBy("id").agg(F.max("label").alias("label"))
    texts = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna()
    single = texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("id")
    drawn = marked.join(single, "id", "left_semi").orderBy(F.xxhash64("id", F.lit(5)), "id").limit(sample)
    # At most ``sample`` ids and labels go to all tasks; texts stay where they are read.
    drawn = stored(drawn, "drawn")
    chosen = texts.join(F.broadcast(drawn), "id")
    kind = chosen.schema["id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffer(batch.column(0))
            for a, z in slices(starts, _SLICE):
                cut = starts[a : z + 1]
                hashes, counts = _hashed(data[cut[0] : cut[-1]], cut - cut[0])
                at = [0, *np.cumsum(counts).tolist()]
                sets = [np.unique(hashes[:, b:e]) for b, e in zip(at[:-1], at[1:])]
                values, n = np.unique(np.concatenate(sets), return_counts=True)
                real = values != 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[real].astype(np.int64)), pa.array(n[real])], ["term", "n"]
                )

    met = chosen.select("text").mapInArrow(counted, "term bigint, n bigint")
    often = met.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    top = often.orderBy(F.desc("n"), "term").limit(terms).select("term").toArrow()
    known = np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffer(batch.column("text"))
            for a, z in slices(starts, _SLICE):
                cut, part = starts[a : z + 1], batch.slice(a, z - a)
                hashes, counts = _hashed(data[cut[0] : cut[-1]], cut - cut[0])
                index, owner, passages = known_terms(hashes, counts, known)
                sizes = np.bincount(owner, minlength=int(passages.sum())).astype(np.int32)
                last = np.cumsum(passages).tolist()
                end = np.cumsum(sizes)[np.array(last, np.int64) - 1].tolist()
                index = index.astype(_narrow(len(known)))
                cuts = [sizes[b:e].tobytes() for b, e in zip([0, *last], last)]
                terms = [index[b:e].tobytes() for b, e in zip([0, *end], end)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), pa.array(cuts, pa.binary()), pa.array(terms, pa.binary())],
                    ["id", "label", "sizes", "terms"],
                )

    if not len(known):
        share = drawn.agg(F.avg("label")).first()[0]
        odds = 0.0 if share is None else float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return Machine(known, odds, np.zeros(0), np.zeros((0, factors)))
    shards = parts_for(sample, -(-sample // SHARDS))
    dealt = chosen.select("id", "label", "text").mapInArrow(placed, f"id {kind}, label int, sizes binary, terms binary")
    dealt = stored(dealt.repartition(shards, F.xxhash64("id", F.lit(6))), "examples")
    # As many tasks as shards at most, so that the models of a round have a bounded size.
    whole = dealt.coalesce(shards).sortWithinPartitions("id")
    model = _fitted(whole.select("label", "sizes", "terms"), len(known), factors, rounds, passes)
    return Machine(
        known, float(model["bias"][0]), model["weights"].astype(np.float32), model["factors"].astype(np.float32)
    )


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (1 from one half up).

    Every word of the whole text is looked up, passage by passage; the highest passage
    decides. Null and empty texts, and texts without a known term, get the score that
    the bias alone gives. Repeated rows are scored alike, empty tables give empty
    results, and input columns named like a result column are replaced.
    """
    docs = small_batches(without(docs, RESULT))
    held = docs.sparkSession.sparkContext.broadcast(machine)
    place = docs.columns.index(text_col)
    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffer(batch.column(place))
            for a, z in slices(starts, _SLICE):  # handed on slice by slice, so that little is held
                cut, part = starts[a : z + 1], batch.slice(a, z - a)
                found = held.value.scores(data[cut[0] : cut[-1]], cut - cut[0])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                    [*part.schema.names, *RESULT],
                )

    return docs.mapInArrow(task, schema)
