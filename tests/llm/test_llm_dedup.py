"""Exact copies, repeated passages and similar documents against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import common
from logloom.llm import similar as similar_module
from logloom.llm.common import components, marked, slots_for
from logloom.llm.exact import PREFIX, exact_dedup, levels
from logloom.llm.similar import least_matches, one_of_each, similar
from logloom.llm.substrings import packed, remove_repeated, unpacked

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, keep_id int, n_words string, `_group` int, class_id string"


def frame(spark, texts):
    """Documents with extra columns named like results and internal columns."""
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in texts], SCHEMA)


def words(rng, n, kinds=40):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def copies(rng):
    texts = [words(rng, rng.randrange(1, 60)) for _ in range(30)]
    texts += ["Ä B c", "Ä b C", "ä b c", "", " ", None, "x" * 300_000, "X" * 300_000, "x" * 299_999 + "y"]
    texts += [t.upper() if t and rng.random() < 0.5 else t for t in rng.choices(texts, k=60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def test_exact_dedup_equals_brute_force(spark):
    rows = copies(random.Random(1))
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(FOLD)].append(i)
    got = {r["doc_id"]: r for r in exact_dedup(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), i == max(ids))
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def by_level(rows):
    """Rows that each level settles: a length of its own, a prefix of its own, the others."""
    folded = [(t or "").translate(FOLD) for _, t in rows]
    size = Counter(len(t.encode()) for t in folded)
    shape = Counter((len(t.encode()), t[:PREFIX]) for t in folded)
    found = Counter()
    for t in folded:
        n = len(t.encode())
        found[1 if size[n] == 1 else 2 if shape[n, t[:PREFIX]] == 1 else 3] += 1
    return found


@pytest.mark.parametrize("most", [common.MOST_SLOTS, 0])
def test_each_level_decides(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_SLOTS", most)
    rows = copies(random.Random(4))
    rows += [(1000 + i, f"{i:04d}" + "same length") for i in range(50)]
    rows += [(2000 + i, "y" * (400_000 + i)) for i in range(20)]
    wanted = by_level(rows)
    assert min(wanted[k] for k in (1, 2, 3)) >= 10
    got = {r["_level"]: r["count"] for r in levels(frame(spark, rows)).groupBy("_level").count().collect()}
    # Without a filter of lengths all rows reach the second level; a row may share a slot by chance.
    assert got.get(1, 0) == (wanted[1] if most else 0)
    assert got[3] == wanted[3] and sum(got.values()) == len(rows)
    kept = {r["doc_id"] for r in exact_dedup(frame(spark, rows)).where("kept").collect()}
    assert kept == set({(t or "").translate(FOLD): i for i, t in sorted(rows)}.values())


def test_filter_grows_with_its_keys(spark):
    keys = spark.range(100_000).select((F.col("id") * 7).alias("k"))
    found = marked(spark.range(700_000).withColumnRenamed("id", "k"), keys, ["k"], "hit")
    wanted = F.col("k") % 7 == 0
    missed, wrong = found.agg(F.count_if(wanted & ~F.col("hit")), F.count_if(~wanted & F.col("hit"))).first()
    assert missed == 0 and wrong < 0.13 * 600_000
    assert slots_for(100_000) == 1 << 20 and slots_for(0) == slots_for(1) == 1 << 15


def test_exact_dedup_without_digests_hashes_survivors_only(spark):
    rows = exact_dedup(frame(spark, [(1, "one"), (2, "two"), (3, "TWO"), (4, "longer text")]), digests=False).collect()
    assert {r["doc_id"] for r in rows if r["text_sha256"]} == {2, 3}


def test_exact_dedup_odd_tables(spark):
    assert exact_dedup(frame(spark, [])).count() == 0
    rows = exact_dedup(frame(spark, [(None, "a"), (5, "A"), (5, "a"), (None, "b")])).collect()
    assert Counter((r["doc_id"], r["kept"], r["group_size"]) for r in rows) == Counter(
        [(None, False, 3), (5, True, 3), (5, True, 3), (None, True, 1)]
    )


@pytest.mark.parametrize("most", [common.MOST_SLOTS, 0])
def test_rows_that_stay_are_the_same_without_the_dropped_ones(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_SLOTS", most)
    rows = copies(random.Random(5))
    rows += [(2000 + i, f"{i:04d}" + "same length") for i in range(50)] + [(1000 + i, "many") for i in range(300)]
    rows += [(1299, "many")] * 3 + [(None, "no id"), (None, "NO ID"), (None, "Many"), (None, "lone")]
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(FOLD)].append(i)
    wanted = Counter((max((i for i in ids if i is not None), default=None), len(ids)) for ids in groups.values())
    got = exact_dedup(frame(spark, rows), digests=False, dropped=False).collect()
    assert Counter((r["doc_id"], r["group_size"]) for r in got) == wanted
    assert all(r["kept"] and r["keep_id"] == r["doc_id"] for r in got)
    for r in got:
        text = (r["text"] or "").translate(FOLD)
        assert r["group_size"] == len(groups[text]) and r["text_sha256"] in (None, hashlib.sha256(text.encode()).hexdigest())


def test_exact_dedup_stays_native(spark):
    plan = exact_dedup(frame(spark, [(1, "a"), (2, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def passages(rng):
    shared = [words(rng, n, 1000) for n in (34, 35, 36, 80)]
    texts = [words(rng, rng.randrange(0, 120), 1000) for _ in range(12)]
    for k, passage in enumerate(shared):
        for at in (k, k + 1, 7):
            texts[at] = texts[at] + "  \n" + passage + "\t " + words(rng, 3, 1000)
    texts += ["same " * 36, "same " * 35, None, "", " \n ", "é a " * 40, "x" * 100_000, texts[3], texts[3]]
    return list(enumerate(texts))


def removed(rows, width=35):
    split = {i: (t or "").encode().split() for i, t in rows}
    seen = Counter()
    for ws in split.values():
        seen.update(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1))
    out = {}
    for i, ws in split.items():
        gone = set()
        for at in range(len(ws) - width + 1):
            if seen[tuple(ws[at : at + width])] > 1:
                gone.update(range(at, at + width))
        out[i] = (len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode())
    return out


@pytest.mark.parametrize("flush", [50, 1 << 21])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, flush):
    import logloom.llm.substrings as module

    monkeypatch.setattr(module, "FLUSH", flush)
    rows = passages(random.Random(2))
    got = remove_repeated(frame(spark, rows).repartition(3))
    assert got.columns[-3:] == ["n_words", "n_removed", "kept_text"]
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()} == removed(rows)


def test_repeated_passages_odd_tables(spark):
    assert remove_repeated(frame(spark, [])).count() == 0
    text = words(random.Random(3), 40, 1000)
    rows = remove_repeated(frame(spark, [(None, text), (1, text), (1, text), (2, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 40), (1, 40), (1, 40), (2, 0)]


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_sketch_chunks_come_back(kind):
    rng = random.Random(4)
    ordered = np.array(sorted(rng.sample(range(1 << 24), 3000)), np.uint32)
    chunks, data, ends = packed(ordered, 100_000, kind)
    begin, out = 0, []
    for chunk, end in zip(chunks.tolist(), ends.tolist()):
        out += [chunk * 100_000 + int(x) for x in unpacked(data[begin:end].tobytes(), kind)]
        begin = end
    assert out == ordered.tolist()


def shingle_set(text):
    ws = (text or "").translate(FOLD).encode().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def brute_links(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    links = Counter()
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, one) in enumerate(sets):
        for b, two in sets[:k]:
            if one and two and len(one & two) >= 0.8 * len(one | two):
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                parent[min(x, y)] = max(x, y)
    return {i: (top(i), links[i]) for i, _ in sets}


def near(rng):
    texts = []
    for _ in range(8):
        base = words(rng, rng.randrange(40, 200), 2000).split()
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(1000)}"
            texts.append(" ".join(own))
    texts += ["a b c", "A b C", "a b", None, "", " ", texts[0].upper(), texts[0], "word " * 5000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [3, 256])
def test_similar_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar_module, "BLOCK", block)
    rows = near(random.Random(5))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar(frame(spark, rows)).collect()}
    assert got == brute_links(rows)


def test_one_of_each_keeps_the_largest_id(spark):
    rows = near(random.Random(6))
    kept = one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert {r["doc_id"] for r in kept.collect()} == {top for top, _ in brute_links(rows).values()}


def test_similar_odd_tables(spark):
    assert similar(frame(spark, [])).count() == 0
    text = words(random.Random(7), 30)
    rows = similar(frame(spark, [(None, text), (4, text), (4, text), (9, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in rows) == [(0, 4, 2), (4, 4, 2), (4, 4, 2), (9, 9, 0)]


def test_pruning_table_keeps_what_may_still_reach_the_threshold():
    table = least_matches(0.8, 1e-6)
    assert all(a <= b for a, b in zip(table, table[1:]))
    assert all(m < 0.8 * 16 * (k + 1) for k, m in enumerate(table))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}
    hub = spark.range(1, 3000).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    assert {r["component"] for r in components(hub).collect()} == {0}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_equal_brute_force_and_write_a_table_a_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(common, "stored", lambda frame, name, f=common.stored: written.append(name) or f(frame, name))
    stars = [(1, 7), (9, 1), (30, 20), (1, 7), (5, 5), (None, 3)]
    got = components(spark.createDataFrame(stars, "a bigint, b bigint")).collect()
    assert {tuple(r) for r in got} == {(1, 1), (7, 1), (9, 1), (20, 20), (30, 20)} and len(got) == 5
    assert written == ["edges"]
    rng = random.Random(12)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(0, k) for k in range(400, 900)]
    links += [(k, 1000) for k in range(700, 1000)]
    top = {x: x for pair in links for x in pair}
    for _ in top:
        before = dict(top)
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
        if top == before:
            break
    alone = {x for x in top if all(a == b for a, b in links if x in (a, b))}
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert sorted(map(tuple, got)) == sorted((x, y) for x, y in top.items() if x not in alone)
