"""Counts of records per minute, and per day and host, which add up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom import schema

MINUTES, DAYS = "minutes", "days"
ROLLUPS = {MINUTES: schema.MINUTES, DAYS: schema.DAYS}


def keys_of(kind: str) -> list[str]:
    return [f.name for f in ROLLUPS[kind] if f.name != "total"]


def rolled(records: DataFrame, kind: str) -> DataFrame:
    """Records counted by the keys of a rollup; counted in each task before they move."""
    at = {"minute": F.date_trunc("minute", "timestamp"), "event_date": F.to_date("timestamp")}
    keys = [at.get(name, F.col(name)).alias(name) for name in keys_of(kind)]
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))


def added(rollups: list[DataFrame], kind: str) -> DataFrame:
    """Rollups of separate records as one."""
    names = keys_of(kind)
    both = reduce(DataFrame.unionByName, [r.select(*names, "total") for r in rollups])
    return both.groupBy(*names).agg(F.sum("total").alias("total"))
