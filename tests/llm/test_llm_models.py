"""Toxicity, vector codes and importance resampling against brute force and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import codes as codes_module
from logloom.llm import common
from logloom.llm import resample as resample_module
from logloom.llm import toxicity
from logloom.llm.codes import decoded, digests, vector_codes
from logloom.llm.resample import crc32_of, features, resample

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# --- toxicity ---------------------------------------------------------------------

INSULTS, GROUPS = ["fool", "rogue", "knave"], ["northerners", "bakers", "sailors"]


def sentences(rng, n):
    """Insults alone and groups alone are harmless; an insult with a group is toxic."""
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 40))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += [rng.choice(INSULTS)] * insult + [rng.choice(GROUPS)] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


@pytest.fixture(scope="module")
def machine_and_rows(spark):
    rows = sentences(random.Random(2), 3000)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 4], "doc_id bigint, toxic int")
    return toxicity.learn(docs.where("doc_id % 4 <> 0"), labels), rows


def test_toxicity_learns_pairs_that_weights_alone_cannot_tell(spark, machine_and_rows):
    machine, rows = machine_and_rows
    held = [r for r in rows if r[0] % 4 == 0]
    docs = spark.createDataFrame([r[:2] for r in held], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in toxicity.score(docs, machine).collect()}
    right = sum(got[i]["predicted"] == label for i, _, label in held)
    assert right / len(held) > 0.95
    place = {w: int(np.searchsorted(machine.terms, toxicity._HASHER.words(
        np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0])) for w in INSULTS + GROUPS}
    for a in INSULTS:
        for b in GROUPS:
            assert machine.factors[place[a]] @ machine.factors[place[b]] > 0


def test_toxicity_scores_equal_the_formula(spark, machine_and_rows):
    machine, _ = machine_and_rows
    rng = random.Random(3)
    pool = INSULTS + GROUPS + [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(pool, k=n)) for n in (0, 1, 2, 50, 127, 128, 129, 256, 257, 900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

    def hashes(word):
        data = np.frombuffer(word.encode(), np.uint8)
        row, _ = toxicity._hashed(data, np.array([0, len(data)]))
        return [h for h in row[:, 0].tolist() if h]

    terms = {t: k for k, t in enumerate(machine.terms.tolist())}
    for row in toxicity.score(docs, machine).collect():
        words = texts[row["doc_id"]].split()
        blocks = [words[a : a + toxicity.BLOCK] for a in range(0, len(words), toxicity.BLOCK)] or [[]]
        passages = [a + b for a, b in zip(blocks, blocks[1:])] or blocks
        best = -math.inf
        for passage in passages:
            own = sorted({terms[h] for w in passage for h in hashes(w) if h in terms})
            z = machine.bias + sum(float(machine.weights[k]) for k in own)
            z += sum(float(machine.factors[a] @ machine.factors[b]) for a in own for b in own if a < b)
            best = max(best, z)
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-best)), abs=1e-4)
        assert row["predicted"] == int(row["score"] >= 0.5)


def test_toxicity_odd_tables(spark, machine_and_rows):
    machine, _ = machine_and_rows
    kinds = "doc_id bigint, text string, score string, predicted string, label int"
    rows = [(1, None, "a", "b", 3), (2, "", "a", "b", 3), (None, "\x00 \n", "a", "b", 3),
            (4, "fool " + "x" * 200_000 + " w1" * 30_000 + " bakers", "a", "b", 3), (2, "", "a", "b", 3)]
    got = toxicity.score(spark.createDataFrame(rows, kinds), machine).collect()
    assert len(got) == 5 and got[0].asDict().keys() == {"doc_id", "text", "label", "score", "predicted"}
    assert len({r["score"] for r in got if not (r["text"] or "").strip("\x00 \n")}) == 1
    assert toxicity.score(spark.createDataFrame([], kinds), machine).count() == 0
    nothing = spark.createDataFrame([], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(rows, kinds)
    blank = toxicity.learn(docs, nothing)
    assert {r["score"] for r in toxicity.score(docs, blank).collect()} == {0.5}
    assert toxicity.learn(docs.limit(0), nothing).terms.size == 0
    # Several labels of one id: toxic if one says so. Id 2 has two rows and is left out.
    few = spark.createDataFrame([(2, 0), (4, 0), (4, 1), (4, None), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.learn(docs, few).bias > 5
    assert toxicity.learn(docs, few.where("doc_id = 2")).bias == 0


# --- vector codes ---------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    def sound(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, label, [math.floor(x * 4096) for x in v]) for i, v, label in rows if sound(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[r[2][p * width : (p + 1) * width] for r in kept] for p in range(parts)]
    books = [[list(x) for x in own[:entries]] for own in cut]

    def assign(p):
        out = []
        for x in cut[p]:
            d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
            out.append((min(d), d.index(min(d))))
        return out

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for x, (_, e) in zip(cut[p], assign(p)):
                own[e].append(x)
            for e, members in own.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    final = [assign(p) for p in range(parts)]
    out = []
    for k, (i, label, _) in enumerate(kept):
        out.append((i, label, "".join(f"{final[p][k][1]:02x}" for p in range(parts)), sum(final[p][k][0] for p in range(parts))))
    by_label = Counter()
    for _, label, _, error in out:
        by_label[label] += error
    text = ",".join(str(c) for own in books for e in own for c in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return Counter((i, code, error, by_label[label], digest) for i, label, code, error in out)


VECTORS = "vec_id bigint, embedding array<float>, label int, row string, position string, entry int, part int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "r", "p", 1, 2) for r in rows], VECTORS)


def some_vectors(rng, n, dims=16):
    return [(i, [float(np.float32(rng.gauss(rng.randrange(3), 0.4))) for _ in range(dims)], rng.choice([None, 0, 1, 2]))
            for i in range(n)]


@pytest.mark.parametrize("owned", [codes_module.OWNED, 40])
def test_vector_codes_equal_brute_force(spark, monkeypatch, owned):
    monkeypatch.setattr(codes_module, "OWNED", owned)
    rng = random.Random(4)
    rows = some_vectors(rng, 150)
    rows += [(900 + k, rows[7][1], 1) for k in range(60)]  # copies
    rows += [(3, rows[3][1], 0), (3, rows[5][1], 0), (None, rows[6][1], 2)]  # ids that repeat, and none
    rows += [(901, None, 0), (902, [1.0] * 15 + [None], 0), (903, [math.nan] * 16, 0), (904, [1.0] * 15 + [math.inf], 1)]
    rng.shuffle(rows)
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    coded = vector_codes(vectors(spark, rows).repartition(5))
    got = Counter(tuple(r[n] for n in names) for r in digests(coded).collect())
    assert got == brute_codes(rows)


def test_vector_codes_decode_near_their_vectors(spark):
    rows = some_vectors(random.Random(5), 200)
    coded = vector_codes(vectors(spark, rows))
    found = {r["id"]: r for r in coded.rows.collect()}
    back = decoded(np.array([found[i]["codes"] for i, *_ in rows]), coded.codebooks)
    given = np.floor(np.array([v for _, v, _ in rows]) * 4096)
    errors = ((given - back * 4096) ** 2).sum(axis=1)
    assert np.allclose(errors, [found[i]["error"] for i, *_ in rows])
    assert errors.mean() < 0.4 * ((given - given.mean(axis=0)) ** 2).sum(axis=1).mean()


def test_vector_codes_odd_tables(spark):
    assert digests(vector_codes(vectors(spark, []))).count() == 0
    assert digests(vector_codes(vectors(spark, [(1, None, 0), (2, [], 0), (3, [1.0], 0)]))).count() == 0
    few = [(5, [1.0] * 8, None), (4, [-2.0] * 8, None), (6, [0.5] * 16, 1), (7, [1e30] * 8, 2)]
    got = {r["vec_id"]: r for r in digests(vector_codes(vectors(spark, few))).collect()}
    assert {i: r["code"] for i, r in got.items()} == {4: "00" * 8, 5: "01" * 8, 7: "02" * 8}
    assert all(r["error"] == 0 for r in got.values())


def test_only_parts_that_change_their_entry_are_shuffled(spark, monkeypatch):
    shares = []
    plain = codes_module.drop_table

    def kept(session, path):
        shares.append(session.read.parquet(path).agg(F.avg((F.col("moved") == "true").cast("int"))).first()[0])
        plain(session, path)

    monkeypatch.setattr(codes_module, "drop_table", kept)
    vector_codes(vectors(spark, some_vectors(random.Random(6), 400))).rows.count()
    assert shares[0] == 1 and all(s < 0.4 for s in shares[1:]) and shares[-1] < 0.15


# --- importance resampling ---------------------------------------------------------------


def test_crc32_and_features_equal_zlib():
    rng = random.Random(7)
    texts = ["", "a", "Ärger B2b  x-y", "x" * 300, "\x00\x01"] + [
        "".join(rng.choices("abZ9 -\xe9中\U0001f600\n", k=rng.randrange(80))) for _ in range(60)
    ]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for words in (1, 3):
        bucket, owner, counts = features(data, starts, words, 10_000)
        got = defaultdict(list)
        for b, d in zip(bucket.tolist(), owner.tolist()):
            got[d].append(b)
        for k, text in enumerate(texts):
            own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(FOLD))
            runs = [" ".join(own[a : a + n]) for n in range(1, words + 1) for a in range(len(own) - n + 1)]
            assert counts[k] == len(own)
            assert sorted(got[k]) == sorted(zlib.crc32(r.encode()) % 10_000 for r in runs)
    assert len(crc32_of(data, np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def brute_draw(docs, target, least=20, percent=10, buckets=10_000):
    def own(text):
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        return [zlib.crc32(w.encode()) % buckets for w in found]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(own(text))
    for text in target:
        t.update(own(text))
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in s}
    rows = []
    for i, text in docs:
        f = own(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(order) * percent // 100
    ranks = Counter((*r, k + 1 if k < drawn else None) for k, r in enumerate(order))
    return ranks + Counter((*r, None) for r in rows if r[1] < least)


def drawn_rows(spark, docs, target, **more):
    docs = spark.createDataFrame([(*d, "r", 1, 2) for d in docs], "doc_id bigint, text string, rank string, score int, run int")
    target = spark.createDataFrame([(t,) for t in target], "text string")
    rows = resample(docs.repartition(6), target, **more).collect()
    return Counter(tuple(r[n] for n in ("doc_id", "n_features", "weight", "score", "rank")) for r in rows)


@pytest.mark.parametrize("segment", [resample_module.SEGMENT, 7])
@pytest.mark.parametrize("percent", [10, 70])
def test_resampling_equals_brute_force(spark, segment, percent):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(200)] + ["Éa", "Z-9"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(300)]
    docs += [(40, docs[5][1])] * 150  # one row many times over
    docs += [(None, docs[9][1]), (-3, None), (-4, ""), (-5, "w1 " * 20_000)]
    target = [" ".join(rng.choices(vocabulary[:30], k=40)) for _ in range(20)] + [None, ""]
    got = drawn_rows(spark, docs, target, segment_rows=segment, percent=percent)
    assert got == brute_draw(docs, target, percent=percent)


def test_resampling_odd_tables(spark):
    assert drawn_rows(spark, [], ["a b"]) == Counter()
    assert drawn_rows(spark, [(1, None), (2, "a b")], []) == brute_draw([(1, None), (2, "a b")], [])


def test_segments_are_of_one_size(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("id"),
        F.lit(1).cast("bigint").alias("n_features"), F.lit(1).cast("bigint").alias("weight"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.xxhash64("id") % 1000).cast("bigint").alias("score"),
    )
    runs = resample_module._sorted_runs(rows.repartition(6, "id"))
    splitters = resample_module._splitters(runs, 20_000, 10)
    sizes = [r["count"] for r in resample_module._in_segments(runs, splitters).groupBy("segment").count().collect()]
    assert len(sizes) == 10 and sum(sizes) == 20_000 and max(sizes) < 2600


def test_workers_hand_memory_back(monkeypatch):
    released = []
    monkeypatch.setattr(common, "release_memory", lambda: released.append(1))
    assert list(common.frugal(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and released == [1]
    cut = common.frugal(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    next(cut)
    cut.close()
    assert released == [1, 1]
