"""Known formats and the choice between them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.sources import base
from logloom.sources.base import LogSource
from logloom.sources.cloudwatch import AwsCloudWatch
from logloom.sources.gcp import GcpCloudLogging
from logloom.sources.jsonlines import JsonLines
from logloom.sources.lines import head_sample

FALLBACK = JsonLines()
SOURCES: tuple[LogSource, ...] = (GcpCloudLogging(), AwsCloudWatch(), FALLBACK)


def source_types(sources: Sequence[LogSource] = SOURCES) -> list[str]:
    return [source.source_type for source in sources]


def check_source_type(
    source_type: str | None, sources: Sequence[LogSource] = SOURCES
) -> str | None:
    """A forced type must be one of the registered ones."""
    if source_type is not None and source_type not in source_types(sources):
        accepted = ", ".join(source_types(sources))
        raise ValueError(f"unknown source type {source_type!r}; accepted: {accepted}")
    return source_type


def scores(sample: DataFrame, sources: Sequence[LogSource] = SOURCES) -> DataFrame:
    """Score of every format per file of a head sample."""
    return (
        base.with_document(sample)
        .groupBy(F.col("arrival.file").alias("file"))
        .agg(*[source.score().alias(source.source_type) for source in sources])
    )


def choice(
    sources: Sequence[LogSource] = SOURCES, fallback: LogSource = FALLBACK
) -> Column:
    """Best score; the fallback wins a tie, then the earlier source."""
    names = source_types(sources)
    best = F.greatest(*[F.col(f"`{name}`") for name in names]) if len(names) > 1 else F.col(
        f"`{names[0]}`"
    )
    picked = F.when(F.col(f"`{fallback.source_type}`") >= best, fallback.source_type)
    for name in names:
        picked = picked.when(F.col(f"`{name}`") == best, name)
    return picked


def detect(
    lines: DataFrame,
    sources: Sequence[LogSource] = SOURCES,
    fallback: LogSource = FALLBACK,
) -> DataFrame:
    """``file, source_type`` plus scores from the head of each file."""
    rated = scores(head_sample(lines), sources)
    return rated.select("file", choice(sources, fallback).alias("source_type"), *[
        F.col(f"`{name}`") for name in source_types(sources)
    ])


def parse_as(
    lines: DataFrame, source_type: str, sources: Sequence[LogSource] = SOURCES
) -> DataFrame:
    check_source_type(source_type, sources)
    chosen = next(source for source in sources if source.source_type == source_type)
    return chosen.parse(lines)


def route(
    lines_by_type: dict[str, DataFrame], sources: Sequence[LogSource] = SOURCES
) -> DataFrame:
    """Parse each format's lines with its own source and put the results together."""
    parsed = [parse_as(lines, name, sources) for name, lines in lines_by_type.items()]
    return reduce(DataFrame.unionByName, parsed)
