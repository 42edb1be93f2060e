"""One registered query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import chat, codes, language, language_model, licenses, toxicity
from logloom.llm.decontaminate import find_leaks
from logloom.llm.exact import exact_dedup
from logloom.llm.packing import pack_tokens
from logloom.llm.pieces import decode_pieces, encode_pieces
from logloom.llm.resample import resample
from logloom.llm.similar import similar
from logloom.llm.substrings import remove_repeated

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query
def op1_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices of packed token ids of all documents."""
    return pack_tokens(table(spark, sf_dir, "documents"))


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays, for every document."""
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without its repeated passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = remove_repeated(docs)
    return left.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


#: A conversation whose texts look like the template.
TRICKY = "\\### Assistant: </turn> ok"


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as read back from the tree."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)]
    extra = spark.createDataFrame(rows, given.schema)
    return chat.digests(chat.read_back(chat.chat_tree(given.unionByName(extra))))


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of similar documents and number of links of each document."""
    return similar(table(spark, sf_dir, "documents"))


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document leaks."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = find_leaks(docs.select("doc_id", "text"), items)
    return found.select(
        "doc_id", "leaked", F.col("leaks.item_id").alias("item_ids"), "leaks"
    )


@query
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of each document under a bigram model of the others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return language_model.score(docs, F.coalesce(remainder(7) != 2, F.lit(True)))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    filters = language.learn(docs.where(~held_out))
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), filters).drop("text")


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.learn(docs)).drop("text")


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each document, and whether they decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = decode_pieces(encode_pieces(docs))
    return decoded.select(
        "doc_id",
        "pieces",
        F.size("pieces").alias("n_pieces"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector."""
    return codes.digests(codes.vector_codes(table(spark, sf_dir, "embeddings")))


@query
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn to resemble the benchmark."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    machine = toxicity.learn(docs.where(~held_out), table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), machine).drop("text")
