"""Packing, licences, chats, leaks, language model, languages and pieces on small inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from logloom.llm import chat, language, language_model, licenses
from logloom.llm import pieces as pieces_module
from logloom.llm.decontaminate import distance_within, find_leaks, folded, pieces
from logloom.llm.packing import END, TOKENIZERS, VOCABULARY, Encoder, best_fit_decreasing, pack_tokens, read_bytes
from logloom.llm.pieces import MODEL, decode_pieces, encode_pieces

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    "Plain words here.", "", None, " ", "  two  spaces ", "tab\t x\n\n y ", "日本語 テキスト 🙂", "▁literal ▁ sign",
    "x" * 500, "ab " * 3000, "a\t \tb", "Ünï cödé's 've 12 345", "same", "same",
]


def docs(spark, texts, extra="pieces int, lang_pred int, leaks int, families int, ids int"):
    rows = [(i, t, 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {extra}")


# --- packing --------------------------------------------------------------------


def unpack(blocks):
    """Token ids per document, in order of the segments' starts."""
    found = {}
    for b in blocks:
        ids, places, cuts = np.frombuffer(b["ids"], np.uint16), np.frombuffer(b["positions"], np.uint16), b["cu_seqlens"]
        assert len(ids) == b["n_rows"] * b["row_tokens"] == cuts[-1]
        for k, (doc, start) in enumerate(zip(b["doc_ids"], b["doc_starts"])):
            own = ids[cuts[k] : cuts[k + 1]]
            assert places[cuts[k] : cuts[k + 1]].tolist() == list(range(len(own)))
            assert cuts[k] // b["row_tokens"] == (cuts[k + 1] - 1) // b["row_tokens"]
            if start >= 0:
                found.setdefault(doc, []).append((start, own))
            else:
                assert doc is None and set(own.tolist()) == {END}
    return {d: np.concatenate([x for _, x in sorted(s, key=lambda p: p[0])]) for d, s in found.items()}


@pytest.mark.parametrize("row", [16, 2048])
def test_packing_is_lossless(spark, row):
    encoder = Encoder(read_bytes(f"{TOKENIZERS}/{VOCABULARY}"))
    found = unpack(pack_tokens(docs(spark, TEXTS).repartition(2), row_tokens=row).collect())
    assert set(found) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        assert found[i][-1] == END
        assert found[i][:-1].tobytes() == encoder.whole(text or "")
        assert encoder.decode(found[i][:-1]) == (text or "")


def test_best_fit_takes_the_tightest_row():
    rows, n = best_fit_decreasing(np.array([6, 5, 4, 3, 2, 10]), 10)
    assert n == 3 and rows[5] not in rows[:5].tolist()
    assert rows[0] == rows[2] and rows[1] == rows[3] == rows[4]
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 65, 500)
    rows, n = best_fit_decreasing(sizes, 64)
    assert np.bincount(rows, weights=sizes).max() <= 64 and set(rows.tolist()) == set(range(n))
    open_rows = []
    for size in sorted(sizes.tolist(), reverse=True):  # the same rule, looking at every row
        fit = min((c for c in open_rows if c >= size), default=64)
        if fit in open_rows:
            open_rows.remove(fit)
        if fit > size:
            open_rows.append(fit - size)
    assert sorted(open_rows) == sorted(int(64 - x) for x in np.bincount(rows, weights=sizes) if x < 64)


def test_packing_odd_tables(spark):
    assert pack_tokens(docs(spark, [])).count() == 0
    twice = spark.createDataFrame([(None, "a"), (None, None), (3, "b"), (3, "b")], "doc_id bigint, text string")
    (block,) = pack_tokens(twice.coalesce(1), row_tokens=64).collect()
    assert Counter(d for d, s in zip(block["doc_ids"], block["doc_starts"]) if s >= 0) == {None: 2, 3: 2}
    with pytest.raises(ValueError):
        pack_tokens(twice, row_tokens=0)


# --- pieces ---------------------------------------------------------------------


def test_pieces_without_dropout_are_the_models(spark):
    held = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{MODEL}")
    rows = encode_pieces(docs(spark, TEXTS), dropout=0.0).collect()
    for r in rows:
        if "▁" not in (r["text"] or ""):
            assert r["pieces"] == held.encode(r["text"] or "")


def test_dropout_varies_and_decodes(spark):
    one, two, same = (
        {r["doc_id"]: (r["pieces"], r["decoded"]) for r in decode_pieces(encode_pieces(docs(spark, TEXTS), seed=s)).collect()}
        for s in (1, 2, 1)
    )
    assert one == same and one != two
    for found in (one, two):
        assert {i: d for i, (_, d) in found.items()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert one[12] == one[13]  # repeated rows
    assert len({tuple(one[9][0][k : k + 4]) for k in range(0, 400)}) > 4  # a word is cut in several ways


def test_rounds_take_the_merges_of_the_agenda(monkeypatch):
    model = pieces_module.PieceModel(read_bytes(f"{TOKENIZERS}/{MODEL}"))
    rng = random.Random(3)
    found = ["".join(rng.choice("aeionrst é日 ") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    keys = np.arange(300, dtype=np.uint64) * np.uint64(977)
    for dropout in (0.0, 0.3):
        a = pieces_module.encode_units(model, found, keys, dropout)
        monkeypatch.setattr(pieces_module, "WIDE", 0)
        b = pieces_module.encode_units(model, found, keys, dropout)
        monkeypatch.undo()
        assert all((x == y).all() for x, y in zip(a, b))


def test_dropout_is_drawn_per_occurrence(spark):
    model = pieces_module.PieceModel(read_bytes(f"{TOKENIZERS}/{MODEL}"))
    texts = [f"international{' x' * k}" for k in range(200)] + ["international " * 4000]
    rows = {r["doc_id"]: r["pieces"] for r in encode_pieces(docs(spark, texts), dropout=0.3).collect()}
    ends = {k: np.cumsum(model.raw_size[ids]) for k, ids in rows.items()}
    size = len(" international")
    first = {tuple(ends[k][ends[k] <= size].tolist()) for k in range(200)}
    assert len(first) > 8  # the same word at the same place of different texts
    within = {tuple((own % size).tolist()) for own in np.split(ends[200], np.searchsorted(ends[200], size * np.arange(1, 4000), side="right"))}
    assert len(within) > 8  # the same word in one text
    again = encode_pieces(docs(spark, texts[::-1]).repartition(3), dropout=0.3).collect()
    assert {r["text"]: r["pieces"] for r in again} == {t: rows[k] for k, t in enumerate(texts)}


def test_saved_merges_are_those_of_the_agenda(monkeypatch):
    model = pieces_module.PieceModel(read_bytes(f"{TOKENIZERS}/{MODEL}"))
    rng = random.Random(12)
    kinds = ["".join(rng.choice("aeionrst é日 ") for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    kinds += ["the", "international", "x" * 60]
    word = np.array([rng.randrange(len(kinds)) for _ in range(4000)])
    keys = np.arange(4000, dtype=np.uint64) * np.uint64(977)
    for dropout in (0.0, 0.1, 0.5):
        a = pieces_module.encode_units(model, kinds, keys, dropout, word)
        monkeypatch.setattr(pieces_module, "WIDE", 0)
        b = pieces_module.encode_units(model, [kinds[i] for i in word], keys, dropout)
        monkeypatch.undo()
        assert all((x == y).all() for x, y in zip(a, b))


def test_words_of_near_lengths_are_merged_together(monkeypatch):
    model = pieces_module.piece_model(read_bytes(f"{TOKENIZERS}/{MODEL}"))
    assert pieces_module.piece_model(read_bytes(f"{TOKENIZERS}/{MODEL}")) is model
    rounds, merged = [], pieces_module.PieceModel.merged
    monkeypatch.setattr(pieces_module.PieceModel, "merged", lambda *a: rounds.append(1) or merged(*a))
    words = ["internationalisation of the whole of the world wide".replace(" ", "")[:n] for n in range(1, 44)]
    pieces_module.encode_units(model, words, np.zeros(43, np.uint64), 0.0)
    # Each round asks up to three times; one length at a time took some 2,000 calls.
    assert len(rounds) < 400


def test_units_of_texts_with_odd_gaps():
    texts = ["a b", "", " a", "a  b a", "b ", "  ", " ", "x\n y", "é 日 a"]
    known, word, count = pieces_module._words(texts)
    found = [known[i] for i in word]
    assert found == [u for t in texts if t for u in pieces_module.units(t)]
    assert count.tolist() == [len(pieces_module.units(t)) if t else 0 for t in texts]


def test_pieces_odd_tables(spark):
    assert decode_pieces(encode_pieces(docs(spark, []))).count() == 0
    none = spark.createDataFrame([(None,)], "pieces array<int>")
    assert decode_pieces(none).first()["decoded"] == ""


# --- licences -------------------------------------------------------------------


def test_licences(spark):
    rng = random.Random(4)
    filler = [" ".join(rng.choice(["the", "of", "river", "house", "and", "green", "work", "public"]) for _ in range(12)) for _ in range(200)]
    notices = {
        "apache": "Licensed under the Apache License, Version 3.1.",
        "mit": "This code is released under the MIT License",
        "gpl": "licensed under the GNU General Public License, version 9",
        "cc-by-nc": "Licensed under CC BY-NC 3.0.",
        "cc-by-sa": "Licensed under CC BY-SA 3.0.",
    }
    texts = [*filler, None, "", "\n \n", "a licence to drive in public", "free work of the general public"]
    texts += [f"{filler[0]}\n\n{notice}\n{filler[1]}" for notice in notices.values()]
    texts.append("\n".join(notices.values()))
    texts.append((filler[2] + "\n") * 3000 + notices["mit"])
    frame = docs(spark, texts)
    model = licenses.learn(frame)
    rows = {r["doc_id"]: r for r in licenses.scan(frame, model).collect()}
    clean = len(filler) + 5
    assert all(not rows[i]["families"] for i in range(clean))
    for k, name in enumerate(notices):
        (found,) = rows[clean + k]["licenses"]
        assert rows[clean + k]["families"] == [name] and found["paragraph"] == 1 and rows[clean + k]["n_paragraphs"] == 3
    assert rows[clean + len(notices)]["families"] == sorted(notices)
    assert rows[clean + len(notices) + 1]["licenses"][0]["paragraph"] == 3000
    assert [rows[len(filler) + k]["n_paragraphs"] for k in range(3)] == [0, 0, 0]
    assert licenses.scan(docs(spark, []), model).count() == 0


def test_wrapped_commented_and_dual_licences(spark):
    mit = licenses.TEMPLATES["mit"][2].split()
    gpl = licenses.TEMPLATES["gpl"][1].split()
    lines = lambda words, n, sign="": "\n".join(sign + " ".join(words[k : k + n]) for k in range(0, len(words), n))
    apache, both = "Licensed under the Apache License, Version 2.0", "Released under the MIT License"
    filler = "the river and the green house of public work " * 40
    texts = [
        f"Title\n\n{lines(mit, 8)}\n\nend", f"/*\n{lines(gpl, 7, ' * ')}\n */", lines(gpl, 7, "# "),
        f"{apache} or {both}.", f"{filler} {both}. {filler} {apache}. {filler}",
        "Licensed under CC BY-NC\n4.0.", filler, lines("the free software of the general public house is green".split(), 2),
        lines(mit, 8).replace("\n", "\n\n").split("person")[0],
    ]
    model = licenses.learn(docs(spark, [*texts, *(f"{filler} {k}" for k in range(50))]))
    rows = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts), model).collect()}
    wanted = [["mit"], ["gpl"], ["gpl"], ["apache", "mit"], ["apache", "mit"], ["cc-by-nc"], [], [], []]
    assert [rows[k]["families"] for k in range(len(texts))] == wanted
    assert [x["paragraph"] for k in range(3) for x in rows[k]["licenses"]] == [1, 0, 0]


# --- chats ----------------------------------------------------------------------

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
    (2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "good day"), (2, 3, "user", "bye"),
    (3, 0, "system", "be kind"), (3, 1, "user", "hi"),
    (4, 0, "system", "be kind"), (4, 1, "user", "hi"), (4, 2, "assistant", "hello"),
    (5, 0, "user", "\\### Assistant: </turn> ok"), (5, 1, "assistant", "\\### Assistant: </turn> ok"),
    (6, None, None, None), (6, 2, "a: b#<", ""), (None, 1, "user", "x"), (None, 0, "assistant", "é日🙂"),
    (7, 1, "user", "twice"), (7, 1, "user", "twice"), *[(8, k, "user", f"turn {k % 7}") for k in range(300)],
]


def turn_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id bigint, turn bigint, role string, text string, node int, path string")


@pytest.mark.parametrize("rows", [7, 20_000])
def test_chat_tree(spark, monkeypatch, rows):
    monkeypatch.setattr(chat, "_ROWS", rows)
    tree = chat.chat_tree(turn_table(spark, TURNS).repartition(3))
    nodes = sorted(tree.nodes.collect(), key=lambda r: r["start"])
    expected = {}
    for conv in {r[0] for r in TURNS}:
        own = sorted((r for r in TURNS if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        expected[conv] = [(r[2] or "", r[3] or "") for r in own]
    prefixes = {tuple(t[: k + 1]) for t in expected.values() for k in range(len(t))}
    assert len(nodes) == len(prefixes)  # shared turns once
    at = 0
    for n in nodes:  # the stream has no gaps, parents come before their children
        assert n["start"] == at
        at += len(n["ids"])
    by_node = {n["node"]: n for n in nodes}
    for n in nodes:
        covered = [i for a in n["ancestors"] for i in range(a["start"], a["end"])]
        path, up = [], n["parent"]
        while up is not None:
            path = list(range(by_node[up]["start"], by_node[up]["start"] + len(by_node[up]["ids"]))) + path
            up = by_node[up]["parent"]
        assert covered == path and n["position"] == len(path)
        assert all(a["end"] < b["start"] for a, b in zip(n["ancestors"], n["ancestors"][1:]))
    # Depth first: the descendants of a node follow it directly.
    place = {n["node"]: k for k, n in enumerate(nodes)}
    last = dict(place)
    size = dict.fromkeys(place, 1)
    for n in reversed(nodes):
        if n["parent"] is not None:
            last[n["parent"]] = max(last[n["parent"]], last[n["node"]])
            size[n["parent"]] += size[n["node"]]
    assert all(last[x] - place[x] + 1 == size[x] for x in place)

    found = {r["conv_id"]: r for r in chat.digests(chat.read_back(tree)).collect()}
    assert set(found) == set(expected)
    for conv, turns in expected.items():
        text = "".join(f"{role}\n{t}\n" for role, t in turns)
        loss = "".join(t for role, t in turns if role == "assistant")
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        shown = sum(len(chat.head(role) + chat.escaped(t) + chat.FOOT) for role, t in turns)
        assert r["formatted_chars"] == shown


def test_chat_tree_of_nothing(spark):
    tree = chat.chat_tree(turn_table(spark, []))
    assert tree.nodes.count() == 0 and chat.digests(chat.read_back(tree)).count() == 0


# --- leaks ----------------------------------------------------------------------


def brute_distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return min(before)


def test_bit_parallel_distance():
    rng = random.Random(5)
    for _ in range(500):
        pattern = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 120)))
        found = distance_within(pattern, text, 200)
        assert found[0] == brute_distance(pattern, text)
        assert brute_distance(pattern, text[: found[1]]) == found[0]


def edited(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + "#" + text[at:], text[:at] + text[at + 1 :], text[:at] + "%" + text[at + 1 :]])
    return text


@pytest.mark.parametrize("block", [100, 1 << 22])
def test_leaks_equal_brute_force(spark, block):
    rng = random.Random(6)
    items = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 90))).strip() for _ in range(8)]
    rows = [(k, t) for k, t in enumerate(items)] + [(20, items[0]), (21, None), (22, " "), (None, items[1]), (23, "Q")]
    texts = [None, "", "  ", "clean text of its own", "has a q"]
    for _ in range(40):
        item = rng.choice(items)
        texts.append("zz yy " * rng.randrange(30) + edited(rng, item.upper(), rng.randrange(0, 14)) + "\n ww" * rng.randrange(3))
    table = spark.createDataFrame([(*r, 1) for r in rows], "item_id bigint, text string, leaked int")
    got = find_leaks(docs(spark, texts), table, block_chars=block)
    for r in got.collect():
        text = folded(r["text"])
        expected = Counter()
        for item, own in rows:
            own = folded(own)
            if own and text and brute_distance(own, text) <= int(0.1 * len(own)):
                expected[item, brute_distance(own, text)] += 1
        assert Counter((x["item_id"], x["distance"]) for x in r["leaks"]) == expected
        assert r["leaked"] == bool(expected)
        for x in r["leaks"]:
            own = folded(next(t for i, t in rows if i == x["item_id"]))
            assert brute_distance(own, text[x["start"] : x["end"]]) == x["distance"]
    assert find_leaks(docs(spark, []), table).count() == 0
    assert not find_leaks(docs(spark, texts), table.limit(0)).where("leaked").count()


def test_pieces_cover_the_item():
    assert "".join(p for _, p in pieces("abcdefg", 3)) == "abcdefg"


# --- language model ---------------------------------------------------------------


@pytest.mark.parametrize("size", [200, 1 << 24])
def test_scores_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(language_model, "GROUP", size)
    monkeypatch.setattr(language_model, "SHARD", size)
    rng = random.Random(8)
    kinds_of = ["The", "the", "a", "B", "c", "é", "日", *(f"w{k}" for k in range(30))]
    texts = [" ".join(rng.choices(kinds_of, k=rng.randrange(9))) for _ in range(60)]
    texts += [" ".join(f"the w{rng.randrange(40)}" for _ in range(rng.randrange(30))) for _ in range(30)]
    texts += [None, "", " \n", "word " * 5000, texts[3], texts[3]]
    frame = docs(spark, texts).repartition(3)
    trained = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    rule = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    tokens = [[*(t or "").translate(FOLD).encode().split(), 0] for t in texts]
    uni, bi, follow = Counter(), Counter(), Counter()
    for own, use in zip(tokens, trained):
        if use:
            uni.update(own)
            bi.update(zip([1, *own], own))
    first, kinds = Counter(), Counter()
    for (v, _), n in bi.items():
        first[v] += n
        kinds[v] += 1
    total, distinct = sum(uni.values()), len(uni)
    for r in language_model.score(frame, rule).collect():
        own = tokens[r["doc_id"]]
        base = full = 0.0
        for v, w in zip([1, *own], own):
            low = (uni[w] + 1) / (total + distinct + 1)
            base += math.log10(low)
            high = (max(bi[v, w] - 0.75, 0) + 0.75 * kinds[v] * low) / first[v] if first[v] else low
            full += math.log10(high)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(uni[w] > 0 for w in own), total)
        assert r["held_out"] == (not trained[r["doc_id"]])
        assert r["base_score"] == pytest.approx(base, abs=1e-8)
        assert r["score"] == pytest.approx(full, abs=0.02 * len(own))


def test_monotone_sequences():
    rng = np.random.default_rng(2)
    for top in (1, 50, 10**6, 2**63):
        values = np.sort(rng.integers(0, top, 400, dtype=np.uint64))
        held = language_model.Monotone.of(values).open()
        assert (held[np.arange(400)] == values).all()
        wanted = np.concatenate((values, rng.integers(0, top + 5, 400, dtype=np.uint64), [np.uint64(0), np.uint64(2**64 - 1)]))
        assert (held.successor(wanted) == np.searchsorted(values, wanted)).all()
    assert language_model.Monotone.of(np.zeros(0, np.uint64)).open().successor(np.array([1], np.uint64)).tolist() == [0]


def test_scores_odd_tables(spark):
    assert language_model.score(docs(spark, []), F.lit(True)).count() == 0
    rows = language_model.score(docs(spark, ["a", None]), F.lit(None).cast("boolean")).collect()
    assert all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0.0 for r in rows)


# --- languages ------------------------------------------------------------------


def test_languages(spark):
    rng = random.Random(9)
    stems = {"xx": ["thon", "wher", "ing", "ed"], "yy": ["eau", "ç", "tion", "é"], "zz": ["sch", "ß", "ung", "ö"]}
    rows = []
    for _ in range(300):
        lang = rng.choice(list(stems))
        text = " ".join("".join(rng.choices(stems[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40)))
        rows.append((len(rows), text, lang))
    rows += [(900, None, "xx"), (901, "12 345 !", "xx"), (902, "", None), (903, "Ω", None), (904, "thoning wheringed", None), (905, "½ ²", "zz")]
    frame = spark.createDataFrame([(*r, 5, "s") for r in rows], "doc_id bigint, text string, lang string, score int, lang_pred string")
    filters = language.learn(frame.where("doc_id % 4 <> 2 OR doc_id >= 900"))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(frame, filters).collect()}
    held = [r for r in rows if r[0] % 4 == 2 and r[0] < 900]
    assert sum(found[i][0] == lang for i, _, lang in held) >= 0.97 * len(held)
    assert [found[i] for i in (900, 901, 902, 905)] == [("und", 0.0)] * 4
    assert found[903][0] in stems and found[904][0] == "xx" and found[904][1] > 0.5
    assert all(0 <= s <= 1 for _, s in found.values())
    assert language.identify(frame.limit(0), filters).count() == 0
    nothing = language.learn(frame.limit(0))
    assert {r["lang_pred"] for r in language.identify(frame, nothing).collect()} == {"und"}


def test_more_languages_than_bits_of_a_word(spark):
    rng = random.Random(10)
    stems = {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(4)] for k in range(67)}
    rows = [(n, " ".join(rng.choices(own, k=12)), lang) for lang, own in stems.items() for n in range(3)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, lang string").coalesce(1)
    filters = language.learn(frame)
    assert filters.languages == tuple(stems)
    found = language.identify(frame, filters).collect()
    assert [r["lang_pred"] for r in found] == [r["lang"] for r in found]


def test_language_names_need_not_be_column_names(spark):
    names = ["en", "EN", "gram", "a`b", "n0", ""]
    rows = [(9 * k + i, f"{chr(97 + 4 * k) * 3}{chr(98 + 3 * k)} " * 40, name) for k, name in enumerate(names) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    filters = language.learn(frame)
    assert filters.languages == tuple(sorted(names))
    found = language.identify(frame, filters).collect()
    assert all(r["lang_pred"] == r["lang"] for r in found)


def test_counting_ngrams_holds_little(monkeypatch):
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(400)) for _ in range(120)]
    langs = [f"l{k % 3}" for k in range(120)]
    rows = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 10]), pa.array(langs[k : k + 10])], ["text", "lang"]) for k in range(0, 120, 10)]
    monkeypatch.setattr(language, "HELD", 20_000)
    monkeypatch.setattr(language, "_SLICE", 1 << 12)
    parts = list(language._count_grams(iter(rows)))
    assert len(parts) > 3 and max(p.num_rows for p in parts) <= 30_000
    got, expected = Counter(), Counter()
    for part in parts:
        for lang, gram, n in zip(*(c.to_pylist() for c in part.columns)):
            got[lang, gram] += n
    for text, lang in zip(texts, langs):
        for width in language.WIDTHS:
            for k in range(len(text) - width + 1):
                value = width
                for sign in text[k : k + width].encode():
                    value = value << 8 | sign
                expected[lang, value] += 1
    assert got == expected
