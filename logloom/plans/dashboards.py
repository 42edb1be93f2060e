"""Dashboard queries answered from the counts that imports keep beside the lines.

A window is cut at whole minutes (or days). What lies between the cuts comes from
the rollups, the edges from the records, of which only those files and row groups
are read that hold them. Records of a store older than its rollups are counted
directly until a compaction has counted them. The results are those of the queries
of ``operators.analytics`` over all records.
"""

from __future__ import annotations

from datetime import datetime, time, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.fingerprint import pattern
from logloom.functions.times import Window
from logloom.operators import analytics, rollups
from logloom.operators.filters import all_of, check_limit, date_bounds, within
from logloom.plans.store import Store

Instant = str | datetime


def cut(window: Window, kind: str) -> tuple[Window | None, list[Window]]:
    """The part of a window made of whole minutes or days, and what is left at its ends."""
    step = timedelta(days=1) if kind == rollups.DAYS else timedelta(minutes=1)

    def floor(moment: datetime) -> datetime:
        if kind == rollups.DAYS:
            return datetime.combine(moment.date(), time(), timezone.utc)
        return moment.replace(second=0, microsecond=0)

    first, last = floor(window.start), floor(window.end)
    if first < window.start:
        first += step
    if first >= last:
        return None, [window] if window.start < window.end else []
    edges = [Window(window.start, first), Window(last, window.end)]
    return Window(first, last), [edge for edge in edges if edge.start < edge.end]


def _edges(store: Store, inner: Window | None, edges: list[Window]) -> list[DataFrame]:
    """Records that the rollups do not answer for."""
    found = [within(store.records(), edge) for edge in edges]
    rest = store.uncounted() if inner else None
    return found if rest is None else [*found, within(rest, inner)]


def counts(store: Store, window: Window) -> DataFrame:
    """``timestamp, fingerprint, service_name, severity_number, total`` of a window."""
    inner, edges = cut(window, rollups.MINUTES)
    found = [analytics.counted(records) for records in _edges(store, inner, edges)]
    if inner or not found:
        minutes = store.rollup(rollups.MINUTES).withColumnRenamed("minute", "timestamp")
        # An empty window takes no minute at all.
        minutes = within(minutes, inner or Window(window.start, window.start))
        found.append(minutes.select(*analytics.counted(minutes).columns))
    return reduce(DataFrame.unionByName, found)


def error_rate(store: Store, start: Instant, end: Instant) -> DataFrame:
    """Records, errors and their ratio per bucket, empty buckets included."""
    window = Window.of(start, end)
    return analytics.rate_of(counts(store, window), window)


def by_service(store: Store, start: Instant, end: Instant) -> DataFrame:
    return analytics.services_of(counts(store, Window.of(start, end)))


def top_issues(
    store: Store, start: Instant, end: Instant, limit: int = analytics.TOP_ISSUES
) -> DataFrame:
    check_limit(limit, analytics.MOST_TOP_ISSUES)
    top = analytics.top_of(counts(store, Window.of(start, end)), limit)
    return analytics.with_issues(top, store.issues())


def spikes(store: Store, start: Instant, end: Instant) -> DataFrame:
    """Both windows are counted apart, as the instant between them may lie inside a minute."""
    window = Window.of(start, end)
    now = counts(store, window).withColumn("current", F.lit(True))
    before = counts(store, window.previous()).withColumn("current", F.lit(False))
    return analytics.with_growth(analytics.grown(now.unionByName(before)), store.issues())


def timeline(store: Store, fingerprint: str, start: Instant, end: Instant) -> DataFrame:
    window = Window.of(start, end)
    mine = counts(store, window).where(F.col("fingerprint") == fingerprint)
    return analytics.rate_of(mine, window).select("bucket", "total")


def blast_radius(store: Store, start: Instant, end: Instant) -> DataFrame:
    """Distinct services and hosts per message pattern, from the counts per day and host.

    All records of an issue have the structure of its sample, so the pattern is found
    once per issue, not once per record.
    """
    window = Window.of(start, end)
    inner, edges = cut(window, rollups.DAYS)
    names = ("fingerprint", "service_name", "host")
    found = [r.select(*names, F.lit(1).cast("bigint").alias("total")) for r in _edges(store, inner, edges)]
    if inner or not found:
        days = store.rollup(rollups.DAYS)
        last = inner.end - timedelta(days=1) if inner else window.start
        days = days.where(all_of(date_bounds(inner.start, last))) if inner else days.where(F.lit(False))
        found.append(days.select(*names, "total"))
    spread = reduce(DataFrame.unionByName, found)
    spread = spread.groupBy(*names).agg(F.sum("total").alias("n"))
    patterns = store.issues().select("fingerprint", pattern(F.col("sample_message")).alias("pattern"))
    return analytics.spread_of(spread.join(patterns, "fingerprint"))
