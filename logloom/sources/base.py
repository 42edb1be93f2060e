"""What a source has to provide, and the parts all sources share."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import schema
from logloom.functions import jsontext
from logloom.functions.text import is_blank


class LogSource(Protocol):
    """A log format: how sure it is about a sample and how it reads a line."""

    source_type: str

    def score(self) -> Column:
        """Aggregate over a file's sample lines (``value``, ``doc``): 0 to 1."""

    def parse(self, lines: DataFrame) -> DataFrame:
        """``arrival, value`` to the draft columns, one row per line."""


def with_document(lines: DataFrame) -> DataFrame:
    """Add ``doc`` (the line as VARIANT, NULL if it is not JSON)."""
    return jsontext.with_parsed(lines.select("arrival", "value"), "value", "doc")


def shape_error(recognized: Column) -> Column:
    """Error code of a line that is no usable object, NULL otherwise."""
    return (
        F.when(is_blank(F.col("value")), schema.EMPTY_LINE)
        .when(F.col("doc").isNull(), schema.MALFORMED)
        .when(~recognized, schema.UNRECOGNIZED)
    )


def line_is_object() -> Column:
    return F.col("doc").isNotNull() & jsontext.starts_object(F.col("value"))


def settled(frame: DataFrame) -> DataFrame:
    """Same rows; filters stay above this point.

    A filter on the error code would otherwise be moved below the parser, with
    the whole parser copied into its condition.
    """
    return frame.select(F.inline(F.array(F.struct(*frame.columns))))


def draft(frame: DataFrame, source_type: str, **columns: Column) -> DataFrame:
    """Arrange columns as a draft; rejected lines keep only the line and the code."""
    good = F.col("error_code").isNull()
    types = {"timestamp": "timestamp", "severity_number": "int"}
    picked = []
    for name in schema.DRAFT_COLUMNS[3:-1]:
        value = columns.get(name, F.lit(None)).cast(types.get(name, "string"))
        picked.append(F.when(good, value).alias(name))
    return frame.select(
        "arrival",
        F.col("value").alias("raw"),
        "error_code",
        *picked,
        F.lit(source_type).alias("source_type"),
    )
