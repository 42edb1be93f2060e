"""The stages of the pipeline against what each should keep."""

import random

import corpus_pipeline

WORDS = "the of and house river green public table window stone water bread light under over".split()


def text(rng, n):
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(60)}x" for _ in range(n))


def test_each_stage_keeps_what_it_should(spark, tmp_path):
    rng = random.Random(1)
    item = "which of these rivers is the longest one in all of the land that was named before"
    near = text(rng, 120).split()
    edited = list(near)
    edited[60] = "changed"
    texts = [text(rng, 80) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(30, None), (31, "12 34"), (32, ""), (40, texts[0].upper()), (41, texts[1]), (41, texts[1])]
    rows += [(50, " ".join(near)), (51, " ".join(edited)), (60, text(rng, 40) + " " + item.upper() + " " + text(rng, 9))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {"language_id": set(range(20)) | {40, 41, 50, 51, 60}}
    kept["exact_dedup"] = kept["language_id"] - {0, 1}
    kept["ngram_jaccard"] = kept["exact_dedup"] - {50}
    kept["decontaminate"] = kept["sentencepiece"] = kept["ngram_jaccard"] - {60}
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        ids = [r["doc_id"] for r in now.select("doc_id").collect()]
        assert set(ids) == kept[name], name
        assert k == 0 or len(ids) == len(set(ids))
        assert k == len(corpus_pipeline.STAGES) - 1 or now.columns == columns
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in whole} == kept["sentencepiece"] and all(r["lossless"] for r in whole)


def test_an_empty_corpus_passes(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pieces_are_written_before_they_are_decoded(spark):
    docs = spark.createDataFrame([(1, "a b  c"), (2, None), (3, "é 日本")], "doc_id bigint, text string")
    found = corpus_pipeline.sentence_pieces(spark, docs, "")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # no job holds the workers of both steps
    rows = {r["doc_id"]: r for r in found.collect()}
    assert rows.keys() == {1, 2, 3} and all(r["lossless"] for r in rows.values())
    assert rows[2]["pieces"] == [] and rows[1]["n_pieces"] == len(rows[1]["pieces"]) > 0


def test_texts_meet_their_groups_in_one_join(spark):
    rows = [(i, f"text {i % 7}" + " more" * (i % 5)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = corpus_pipeline.exact_copies(spark, docs, "")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(5, 40))
