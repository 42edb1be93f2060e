"""Canonical records from parsed drafts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import schema
from logloom.functions.fingerprint import fingerprint, record_id
from logloom.functions.times import instant_lit, parse_instant


def assemble(
    drafts: DataFrame,
    observed_at: datetime,
    import_job_id: Column,
) -> DataFrame:
    """Drafts to full lines: id, ingest time and fingerprint; rejects keep none of them.

    The id is derived from the job and the place of the line, so computing it
    again gives the same id.
    """
    good = F.col("error_code").isNull()
    at = F.col("arrival")
    identity = record_id(import_job_id, at["file"], at["block"], at["row"], at["event"])
    columns = {
        "id": F.when(good, identity),
        "observed_at": F.when(good, instant_lit(parse_instant(observed_at))),
        "fingerprint": F.when(
            good, fingerprint(F.col("body"), F.col("service_name"), F.col("severity_number"))
        ),
        "import_job_id": import_job_id,
    }
    return drafts.select(
        *[
            columns.get(name, F.col(name)).alias(name)
            for name in schema.RECORD_COLUMNS + ("error_code",)
        ]
    )


def records(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("error_code").isNull()).select(*schema.RECORD_COLUMNS)


def rejects(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("error_code").isNotNull()).select(
        "import_job_id", "source_type", "arrival", "raw", "error_code"
    )


def error_counts(lines: DataFrame) -> DataFrame:
    return (
        lines.where(F.col("error_code").isNotNull())
        .groupBy("source_type", "error_code")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


def run_totals(lines: DataFrame, *keys: str) -> DataFrame:
    """Processed lines (blank ones included), parse errors and ingested records."""
    return lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("processed_lines"),
        F.count_if(F.col("error_code").isNotNull()).alias("parse_errors"),
        F.count_if(F.col("error_code").isNull()).alias("ingested_records"),
    )


def occurrences(records: DataFrame) -> DataFrame:
    """The part of a record that its issue needs."""
    return records.select(
        "fingerprint",
        F.col("body").alias("message"),
        "severity_number",
        "service_name",
        F.col("timestamp").alias("occurred_at"),
        "arrival",
    )


def fingerprints(records: DataFrame) -> DataFrame:
    return records.select("fingerprint").distinct()
