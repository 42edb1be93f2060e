"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import common
from logloom.llm.common import ascii_lower, join_unique, marked, slots_for, stored, without

#: Bytes of the text that the second level looks at.
PREFIX = 64
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def levels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_level``, the level that settles a row: 1 length, 2 prefix, 3 full text.

    Lengths are counted first, prefixes are hashed only where the length occurs
    again. Filters of the lengths and prefixes that occur again grow with their
    number; a shared slot takes a row one level further than it need go. Beyond the
    largest filter rows meet the prefixes that occur again in a join.
    """
    docs = without(docs, ["_level", "_size", "_prefix", "_again", "_slot", "_word", "_bits", "_fan", "_salt"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.withColumn("_size", F.octet_length(text))
    lengths = sized.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    first = marked(sized, stored(lengths, "lengths"), ["_size"], "_again")
    again = first.where("_again").drop("_again")
    again = again.withColumn("_prefix", F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX))))

    shape = ["_size", "_prefix"]
    shapes = stored(again.groupBy(*shape).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shapes")
    if slots_for(shapes.count()) <= common.MOST_SLOTS:
        second = marked(again, shapes, shape, "_again")
    else:
        known = shapes.select(*shape, F.lit(True).alias("_again"))
        second = join_unique(again, known, shape, [id_col], "left", shapes)
    third = F.when(F.col("_again"), 3).otherwise(2).alias("_level")
    alone = first.where(~F.col("_again")).select(*docs.columns, F.lit(1).alias("_level"))
    return alone.unionByName(second.select(*docs.columns, third))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = True, dropped: bool = True
) -> DataFrame:
    """``docs`` with ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z; of equal texts
    the row with the largest id stays.

    1. One scan counts texts by length in bytes; a length that occurs once settles
       its document.
    2. Prefixes of the others are hashed and counted by length, which settles more.
    3. Only texts whose length and prefix occur again are hashed in full and grouped.

    Only rows of the third level are shuffled. A group that holds many rows is dealt
    over several tasks. ``digests`` gives ``text_sha256`` to settled rows, too;
    without it these are never hashed, and have null there.

    Without ``dropped`` only the rows that stay come back, and of those that repeat
    an id and text a single one. Then filters of the hashes that occur again, and of
    the rows that stay, go to all tasks; a text moves only where it is one of several
    copies and stays, or shares a slot with such a one.

    Null text counts as empty. Rows with the same id and text are one document and
    share its fate; null is the smallest id. Empty tables give empty results. Input
    columns named like a result column are replaced.
    """
    docs = without(docs, [*RESULT, "_hash", "_best", "_n", "_again", "_stays", "_slot", "_word", "_bits"])
    found = levels(docs, id_col, text_col)
    full = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)
    survivors = found.where("_level = 3").drop("_level").withColumn("_hash", full)
    settled = found.where("_level < 3").drop("_level")

    groups = stored(
        survivors.groupBy("_hash").agg(F.max(id_col).alias("_best"), F.count(F.lit(1)).alias("_n")),
        "groups",
    )
    single = []
    if not dropped:
        often = groups.where("_n > 1").select("_hash", F.col("_best").alias(id_col))
        again = marked(survivors, often, ["_hash"], "_again")
        single = [again.where(~F.col("_again")).drop("_again").withColumnRenamed("_hash", "text_sha256")]
        # Rows that are marked by chance are the best of their groups, too.
        best = groups.select("_hash", F.col("_best").alias(id_col))
        survivors = marked(again.where("_again").drop("_again"), best, ["_hash", id_col], "_stays")
        survivors = survivors.where("_stays").drop("_stays")
    joined = join_unique(
        survivors, groups, ["_hash"], [id_col], "inner", groups.select("_hash", F.col("_n").alias("n"))
    )
    if not dropped:
        joined = joined.where(F.col(id_col).eqNullSafe(F.col("_best"))).dropDuplicates([id_col, "_hash"])
    grouped = joined.withColumns(
        {
            "keep_id": F.col("_best"),
            "group_size": F.col("_n"),
            "kept": F.col(id_col).eqNullSafe(F.col("_best")),
            "text_sha256": F.col("_hash"),
        }
    ).drop("_hash", "_best", "_n")
    settled = settled.withColumn("text_sha256", full if digests else F.lit(None).cast("string"))
    for rows in [settled, *single]:
        alone = {"keep_id": F.col(id_col), "group_size": F.lit(1).cast("bigint"), "kept": F.lit(True)}
        grouped = grouped.unionByName(rows.withColumns(alone))
    return grouped
