"""State changes of issues, kept in the store."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.times import parse_instant
from logloom.operators import issues as issue_ops
from logloom.plans.store import Store


def store_actions(
    store: Store, actions: DataFrame, run: str, now: datetime | None = None
) -> DataFrame:
    """Apply ``fingerprint, action, at`` rows to the stored issues; returns the refused ones.

    The changed issues become a snapshot of their own, published under ``run``, so
    later imports see them; an issue resolved here comes back as a regression. A
    run that is already published is left alone.
    """
    if not store.is_published(run):
        version, parts = store.issues_version(), store.issue_parts()
        touched = store.touched(actions, len(parts))
        changed, refused = issue_ops.apply_actions(store.issues(buckets=touched), actions)
        store.write_refused(refused, run)
        parts = store.write_issues(changed, version + 1, parts, touched)
        nothing = store.spark.range(1).select(
            F.lit(0).cast("bigint").alias("processed_lines"),
            F.lit(0).cast("bigint").alias("parse_errors"),
            F.lit(None).cast("timestamp").alias("first_event"),
            F.lit(None).cast("timestamp").alias("last_event"),
        )
        at = parse_instant(now or datetime.now(timezone.utc))
        store.publish(run, version + 1, parts, nothing, at)
    return store.refused(run)
