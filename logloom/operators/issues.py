"""Issue state: folding occurrences, merging with stored issues, state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logloom import schema

# State changes a user can ask for.
RESOLVE, IGNORE, REOPEN = "resolve", "ignore", "reopen"
ACTIONS = (RESOLVE, IGNORE, REOPEN)


def fold(occurrences: DataFrame) -> DataFrame:
    """One row per fingerprint from occurrences in any order.

    Rows are combined per (fingerprint, service) before they leave their task,
    so a fingerprint that holds most rows sends one row per task. The second
    step sees one row per service.
    """
    first = F.struct(
        F.col("message").alias("sample_message"), "severity_number", "occurred_at"
    )
    per_service = occurrences.groupBy("fingerprint", "service_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("occurred_at").alias("last_seen"),
        F.min_by(first, "arrival").alias("first"),
        F.min("arrival").alias("arrival"),
        # Empty for a missing service, else the name.
        F.collect_set("service_name").alias("services"),
    )
    per_issue = per_service.groupBy("fingerprint").agg(
        F.sum("n").alias("event_count"),
        F.max("last_seen").alias("last_seen"),
        F.min_by("first", "arrival").alias("first"),
        F.sort_array(F.collect_list(F.struct("arrival", "services"))).alias("services"),
    )
    return per_issue.select(
        "fingerprint",
        F.col("first.sample_message").alias("sample_message"),
        F.col("first.severity_number").alias("severity_number"),
        F.col("first.occurred_at").alias("first_seen"),
        "last_seen",
        "event_count",
        F.flatten(F.col("services.services")).alias("affected_services"),
    )


def opened(folded: DataFrame) -> DataFrame:
    """Folded occurrences as new issues."""
    return folded.select(
        *folded.columns,
        F.lit(schema.UNRESOLVED).alias("status"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.lit(False).alias("regression"),
    )


def merge(stored: DataFrame, folded: DataFrame) -> DataFrame:
    """Stored issues with a batch laid on top.

    A stored issue keeps its first sighting, sample and severity; an issue that
    had been resolved comes back as a regression.
    """
    old = stored.select(F.col("fingerprint"), F.struct(*stored.columns).alias("old"))
    new = folded.select(F.col("fingerprint"), F.struct(*folded.columns).alias("new"))
    both = old.join(new, "fingerprint", "full_outer")
    known, hit = F.col("old").isNotNull(), F.col("new").isNotNull()
    returns = known & hit & (F.col("old.status") == schema.RESOLVED)

    def kept(name: str) -> Column:
        return F.when(known, F.col(f"old.{name}")).otherwise(F.col(f"new.{name}")).alias(name)

    nobody = F.array().cast("array<string>")
    return both.select(
        "fingerprint",
        kept("sample_message"),
        kept("severity_number"),
        kept("first_seen"),
        F.greatest("old.last_seen", "new.last_seen").alias("last_seen"),
        (
            F.coalesce("old.event_count", F.lit(0)) + F.coalesce("new.event_count", F.lit(0))
        ).alias("event_count"),
        F.array_distinct(
            F.concat(
                F.coalesce("old.affected_services", nobody),
                F.coalesce("new.affected_services", nobody),
            )
        ).alias("affected_services"),
        F.when(known & ~returns, F.col("old.status"))
        .otherwise(schema.UNRESOLVED)
        .alias("status"),
        F.when(known & ~returns, F.col("old.resolved_at")).alias("resolved_at"),
        F.when(returns, True)
        .otherwise(F.coalesce("old.regression", F.lit(False)))
        .alias("regression"),
    )


def upsert(stored: DataFrame, occurrences: DataFrame) -> DataFrame:
    return merge(stored, fold(occurrences))


def status_from_code(code: Column) -> Column:
    return F.lower(code)


def status_code(status: Column) -> Column:
    return F.upper(status)


# --- state changes ---------------------------------------------------------
#
# The actions of an issue form a chain: each one needs the state the one before
# left. An ``ignore`` always leads to the same state, so the chain falls apart
# into stretches, and inside a stretch only the first accepted ``reopen`` and the
# first accepted ``resolve`` matter. Running aggregates over a day of one issue
# give the state for each state the day may start in; the days of an issue are
# then chained. No group of actions is gathered into one value.


def _state_after(start: Column, opened_: Column, resolved: Column, resolved_open: Column) -> Column:
    """State inside a stretch that began in ``start``."""
    return (
        F.when(start == schema.RESOLVED, schema.RESOLVED)
        .when(
            start == schema.UNRESOLVED,
            F.when(resolved, schema.RESOLVED).otherwise(schema.UNRESOLVED),
        )
        .when(resolved_open, schema.RESOLVED)
        .when(opened_, schema.UNRESOLVED)
        .otherwise(schema.IGNORED)
    )


def _walk(actions: DataFrame) -> DataFrame:
    """Per action: the state before and after it, for every state its day may begin in."""
    day = W.partitionBy("fingerprint", "day").orderBy("at", "action")
    so_far = day.rowsBetween(W.unboundedPreceding, W.currentRow)
    stretch = W.partitionBy("fingerprint", "day", "stretch").orderBy("at", "action")
    in_stretch = stretch.rowsBetween(W.unboundedPreceding, W.currentRow)
    action = F.col("action")
    rows = (
        actions.withColumn("day", F.to_date("at"))
        .withColumn("stretch", F.count_if(action == IGNORE).over(so_far))
        .withColumn(
            "opened", F.max(action == REOPEN).over(in_stretch)
        )
        .withColumn("resolved", F.max(action == RESOLVE).over(in_stretch))
        .withColumn(
            "resolved_open",
            F.max((action == RESOLVE) & F.col("opened")).over(in_stretch),
        )
    )
    for start in schema.STATUSES:
        begin = F.when(F.col("stretch") > 0, schema.IGNORED).otherwise(start)
        rows = rows.withColumn(
            f"after_{start}",
            _state_after(begin, F.col("opened"), F.col("resolved"), F.col("resolved_open")),
        )
    for start in schema.STATUSES:
        rows = rows.withColumn(
            f"before_{start}", F.coalesce(F.lag(f"after_{start}").over(day), F.lit(start))
        )
    return rows


def _accepted(before: Column) -> Column:
    action = F.col("action")
    return before.isNotNull() & (
        (action == IGNORE)
        | ((action == RESOLVE) & (before == schema.UNRESOLVED))
        | ((action == REOPEN) & (before == schema.IGNORED))
    )


def apply_actions(issues: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ``fingerprint, action, at`` rows in time order.

    Returns the issues and the actions that were refused: ``resolve`` needs an
    unresolved issue, ``reopen`` an ignored one, and every action a known issue.
    """
    walked = _walk(actions.select("fingerprint", "action", "at"))
    last = {
        f"end_{s}": F.max_by(f"after_{s}", F.struct("at", "action")) for s in schema.STATUSES
    }
    days = walked.groupBy("fingerprint", "day").agg(
        *[value.alias(name) for name, value in last.items()]
    )
    chain = (
        days.groupBy("fingerprint")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("day", *last))
            ).alias("days")
        )
        .join(issues.select("fingerprint", "status"), "fingerprint")
    )

    def next_state(state: Column, day: Column) -> Column:
        return (
            F.when(state == schema.UNRESOLVED, day[f"end_{schema.UNRESOLVED}"])
            .when(state == schema.RESOLVED, day[f"end_{schema.RESOLVED}"])
            .otherwise(day[f"end_{schema.IGNORED}"])
        )

    # State at the start of every day, from a fold over the days before it.
    starts = chain.select(
        "fingerprint",
        F.explode(
            F.aggregate(
                "days",
                F.struct(
                    F.col("status").alias("state"),
                    F.array().cast("array<struct<day:date,start:string>>").alias("seen"),
                ),
                lambda acc, day: F.struct(
                    next_state(acc["state"], day).alias("state"),
                    F.concat(
                        acc["seen"],
                        F.array(
                            F.struct(day["day"].alias("day"), acc["state"].alias("start"))
                        ),
                    ).alias("seen"),
                ),
            )["seen"]
        ).alias("entry"),
    ).select("fingerprint", "entry.day", "entry.start")

    def by_start(prefix: str) -> Column:
        return (
            F.when(F.col("start") == schema.UNRESOLVED, F.col(f"{prefix}_{schema.UNRESOLVED}"))
            .when(F.col("start") == schema.RESOLVED, F.col(f"{prefix}_{schema.RESOLVED}"))
            .otherwise(F.col(f"{prefix}_{schema.IGNORED}"))
        )

    judged = walked.join(starts, ["fingerprint", "day"], "left").select(
        "fingerprint",
        "action",
        "at",
        F.when(F.col("start").isNotNull(), by_start("before")).alias("before"),
        F.when(F.col("start").isNotNull(), by_start("after")).alias("after"),
    )
    judged = judged.withColumn(
        "accepted", F.coalesce(_accepted(F.col("before")), F.lit(False))
    )
    refused = judged.where(~F.col("accepted")).select(
        "fingerprint", "action", "at", F.col("before").alias("status")
    )

    order = F.struct("at", "action")
    resolved = F.col("accepted") & (F.col("action") == RESOLVE)
    cleared = F.col("accepted") & (F.col("action") == REOPEN)
    changes = judged.groupBy("fingerprint").agg(
        F.max_by("after", order).alias("new_status"),
        F.max(F.when(resolved, F.col("at"))).alias("last_resolve"),
        F.max(F.when(cleared, F.col("at"))).alias("last_reopen"),
        F.max_by(
            F.when(resolved, F.col("at")),
            F.when(resolved | cleared, order),
        ).alias("new_resolved_at"),
    )
    touched = F.col("last_resolve").isNotNull() | F.col("last_reopen").isNotNull()
    changed = issues.join(changes, "fingerprint", "left").select(
        *[
            {
                "status": F.coalesce("new_status", "status"),
                "resolved_at": F.when(touched, F.col("new_resolved_at")).otherwise(
                    F.col("resolved_at")
                ),
                "regression": F.when(F.col("last_resolve").isNotNull(), False).otherwise(
                    F.col("regression")
                ),
            }
            .get(name, F.col(name))
            .alias(name)
            for name in issues.columns
        ]
    )
    return changed, refused
