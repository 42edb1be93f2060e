"""Dashboard queries over records and issues."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import severity
from logloom.functions.fingerprint import pattern
from logloom.functions.times import Window, instant_lit
from logloom.operators.filters import check_limit, within

TOP_ISSUES, MOST_TOP_ISSUES = 10, 50
SPIKE_FACTOR = 3

Instant = str | datetime


def counted(records: DataFrame) -> DataFrame:
    """Records as rows of counts, each with a count of one; a rollup has larger ones."""
    one = F.lit(1).cast("bigint").alias("total")
    return records.select("timestamp", "fingerprint", "service_name", "severity_number", one)


def _total():
    return F.sum("total")


def _errors():
    error = F.when(F.col("severity_number") >= severity.ERROR, F.col("total"))
    return F.coalesce(F.sum(error), F.lit(0).cast("bigint"))


def buckets(records: DataFrame, window: Window) -> DataFrame:
    """Start of every bucket the window touches; none for an empty window."""
    spark = records.sparkSession
    first, last = window.bucket_bounds()
    if window.bucket_count() == 0:
        return spark.range(0).select(instant_lit(first).alias("bucket"))
    step = F.expr(f"interval 1 {window.bucket_unit()}")
    return spark.range(1).select(
        F.explode(F.sequence(instant_lit(first), instant_lit(last), step)).alias("bucket")
    )


def error_rate(records: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """Records, errors and their ratio per bucket, empty buckets included."""
    window = Window.of(start, end)
    return rate_of(counted(within(records, window)), window)


def rate_of(counts: DataFrame, window: Window) -> DataFrame:
    """``error_rate`` from counts inside the window."""
    per_bucket = counts.groupBy(
        F.date_trunc(window.bucket_unit(), "timestamp").alias("bucket")
    ).agg(_total().alias("total"), _errors().alias("errors"))
    total = F.coalesce("total", F.lit(0)).cast("bigint")
    errors = F.coalesce("errors", F.lit(0)).cast("bigint")
    return (
        buckets(counts, window)
        .join(per_bucket, "bucket", "left")
        .select(
            "bucket",
            total.alias("total"),
            errors.alias("errors"),
            F.when(total == 0, F.lit(0.0))
            .otherwise(errors.cast("double") / total)
            .alias("ratio"),
        )
        .orderBy("bucket")
    )


def by_service(records: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """Records and errors per service, largest first; no service counts as unknown."""
    return services_of(counted(within(records, Window.of(start, end))))


def services_of(counts: DataFrame) -> DataFrame:
    return (
        counts.groupBy(F.coalesce("service_name", F.lit(severity.UNKNOWN)).alias("service_name"))
        .agg(_total().alias("total"), _errors().alias("errors"))
        .orderBy(F.desc("total"), "service_name")
    )


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.select(
        "fingerprint",
        "sample_message",
        F.col("severity_number").alias("severity"),
        "event_count",
        "first_seen",
        F.col("affected_services").alias("services"),
    )


def new_issues(issues: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """Issues first seen in the window, newest first."""
    window = Window.of(start, end)
    return issue_summary(within(issues, window, "first_seen")).orderBy(
        F.desc("first_seen"), "fingerprint"
    )


def top_fingerprints(
    records: DataFrame, start: Instant, end: Instant, limit: int = TOP_ISSUES
) -> DataFrame:
    return top_of(counted(within(records, Window.of(start, end))), limit)


def top_of(counts: DataFrame, limit: int = TOP_ISSUES) -> DataFrame:
    check_limit(limit, MOST_TOP_ISSUES)
    return (
        counts.groupBy("fingerprint")
        .agg(_total().alias("window_count"))
        .orderBy(F.desc("window_count"), "fingerprint")
        .limit(limit)
    )


def top_issues(
    records: DataFrame,
    issues: DataFrame,
    start: Instant,
    end: Instant,
    limit: int = TOP_ISSUES,
) -> DataFrame:
    """Issues with most records in the window; the count is that of the window.

    Ranking and cutting come before the join, so its small side has at most 50 rows.
    """
    return with_issues(top_fingerprints(records, start, end, limit), issues)


def with_issues(top: DataFrame, issues: DataFrame) -> DataFrame:
    return (
        issue_summary(issues)
        .join(F.broadcast(top), "fingerprint")
        .withColumn("event_count", F.col("window_count"))
        .drop("window_count")
        .orderBy(F.desc("event_count"), "fingerprint")
    )


def spike_counts(records: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """Fingerprints that grew at least threefold over the window just before.

    Both windows are counted in one pass. A fingerprint missing from the earlier
    window is not a spike.
    """
    window = Window.of(start, end)
    before = window.previous()
    boundary = instant_lit(window.start)
    both = counted(within(records, Window(before.start, window.end)))
    return grown(both.withColumn("current", F.col("timestamp") >= boundary))


def grown(counts: DataFrame) -> DataFrame:
    """``spike_counts`` from counts marked as ``current`` or of the window before."""

    def of(mark: Column) -> Column:
        return F.coalesce(F.sum(F.when(mark, F.col("total"))), F.lit(0).cast("bigint"))

    return (
        counts.groupBy("fingerprint")
        .agg(of(F.col("current")).alias("current_count"), of(~F.col("current")).alias("previous_count"))
        .where(
            (F.col("previous_count") > 0)
            & (F.col("current_count") >= F.col("previous_count") * SPIKE_FACTOR)
        )
    )


def spikes(records: DataFrame, issues: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """Spiking issues with both counts and the growth factor."""
    return with_growth(spike_counts(records, start, end), issues)


def with_growth(counts: DataFrame, issues: DataFrame) -> DataFrame:
    return (
        issue_summary(issues)
        .join(counts, "fingerprint")
        .withColumn(
            "multiplier", F.col("current_count").cast("double") / F.col("previous_count")
        )
        .orderBy(F.desc("multiplier"), "fingerprint")
    )


def regressions(issues: DataFrame) -> DataFrame:
    """Issues that came back after they had been resolved."""
    return issue_summary(issues.where("regression")).orderBy("fingerprint")


def blast_radius(records: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """Distinct services and hosts per message pattern.

    The fingerprint holds the service, so the pattern alone is the group.
    Counting goes over the distinct (pattern, service, host) triples.
    """
    spread = (
        within(records, Window.of(start, end))
        .select(pattern(F.col("body")).alias("pattern"), "service_name", "host")
        .groupBy("pattern", "service_name", "host")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return spread_of(spread)


def spread_of(spread: DataFrame) -> DataFrame:
    return spread.groupBy("pattern").agg(
        F.count_distinct("service_name").alias("services"),
        F.count_distinct("host").alias("hosts"),
        F.sum("n").alias("total"),
    )


def timeline(
    records: DataFrame, fingerprint: str, start: Instant, end: Instant
) -> DataFrame:
    """Occurrences of one issue over time, empty buckets included."""
    return error_rate(records.where(F.col("fingerprint") == fingerprint), start, end).select(
        "bucket", "total"
    )
