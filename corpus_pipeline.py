"""A corpus made ready for training: languages, copies, near copies, benchmark passages, pieces.

Every stage takes the documents that the one before it kept, and returns the same
columns; the last one returns the pieces of each document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import language
from logloom.llm.common import stored
from logloom.llm.decontaminate import find_leaks
from logloom.llm.exact import exact_dedup
from logloom.llm.pieces import decode_pieces, encode_pieces
from logloom.llm.similar import one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language go on; those without any (null, or not a letter) go."""
    found = language.identify(docs, language.learn(docs))
    return found.where(F.col("lang_pred") != language.UNDETERMINED).select(docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts goes on; rows that repeat an id and text count once."""
    return exact_dedup(docs, digests=False, dropped=False).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each class of similar texts goes on."""
    return one_of_each(docs).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item go on."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(docs, items).where(~F.col("leaked")).select(docs.columns)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each document, and a digest of the text that they decode to."""
    # Written in between: in one job the workers of both steps would be there at once.
    decoded = decode_pieces(stored(encode_pieces(docs), "pieces"))
    return decoded.select(
        "doc_id",
        "pieces",
        F.size("pieces").alias("n_pieces"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("decontaminate", decontaminated),
    ("sentencepiece", sentence_pieces),
]

#: Language identification and merge dropout have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
