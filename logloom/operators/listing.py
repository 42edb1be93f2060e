"""Filtered lists with caps and keyset paging."""

from __future__ import annotations

import base64
import binascii
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from logloom import schema
from logloom.functions.times import instant_text, iso_text, parse_instant
from logloom.operators import filters

DEFAULT_PAGE, LARGEST_PAGE = 50, 200
MOST_ISSUES = 500

Levels = Iterable[int | str] | int | str | None


@dataclass(frozen=True)
class Cursor:
    """Place in the list: the last row already shown."""

    timestamp: datetime
    id: str

    def encode(self) -> str:
        text = json.dumps({"timestamp": instant_text(self.timestamp), "id": self.id})
        return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")

    @classmethod
    def decode(cls, token: str) -> Cursor:
        try:
            padded = token + "=" * (-len(token) % 4)
            fields = json.loads(base64.b64decode(padded, altchars=b"-_", validate=True))
            return cls(parse_instant(fields["timestamp"]), str(uuid.UUID(fields["id"])))
        except (
            ValueError, TypeError, KeyError, AttributeError, binascii.Error, UnicodeDecodeError
        ) as error:
            raise ValueError("the pagination cursor is malformed") from error


@dataclass(frozen=True)
class Page:
    records: list[Row]
    next_cursor: str | None


def log_clauses(
    *,
    level: Levels = None,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    service: str | None = None,
    q: str | None = None,
    cursor: str | None = None,
) -> list[Column]:
    clauses = (
        filters.level_is(level)
        + filters.time_bounds(start, end)
        + filters.service_is(service)
        + filters.body_contains(q)
    )
    if cursor is not None:
        place = Cursor.decode(cursor)
        clauses += filters.after_cursor(place.timestamp, place.id)
    return clauses


def log_rows(
    records: DataFrame,
    *,
    level: Levels = None,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    service: str | None = None,
    q: str | None = None,
    limit: int = DEFAULT_PAGE,
    cursor: str | None = None,
) -> DataFrame:
    """Rows of one page and one more, newest first, as a DataFrame."""
    filters.check_limit(limit, LARGEST_PAGE)
    clauses = log_clauses(
        level=level, start=start, end=end, service=service, q=q, cursor=cursor
    )
    if "event_date" in records.columns:
        clauses += filters.date_bounds(start, end)
        if cursor is not None:
            clauses += filters.date_bounds(None, Cursor.decode(cursor).timestamp)
    return (
        records.where(filters.all_of(clauses))
        .select(*schema.LIST_COLUMNS)
        .orderBy(F.desc("timestamp"), F.desc("id"))
        .limit(limit + 1)
    )


# Stretches of time searched one after the other, newest first, before everything.
LOOK_BACK = (timedelta(days=1), timedelta(days=7), timedelta(days=30))


def list_logs(
    records: DataFrame,
    *,
    limit: int = DEFAULT_PAGE,
    newest: datetime | None = None,
    **params,
) -> Page:
    """One page of records and the cursor of the next one, None on the last page.

    ``newest`` is the time of the newest record, where it is known. The search then
    goes back from there (or from the cursor, or the upper bound) a day, a week, a
    month, and reads on only while the page is not full. The page is the same.
    """
    found: list[Row] = []
    for start in _starts(newest, params):
        bounds = params if start is None else {**params, "start": start}
        # Time and id travel as text, so that no clock zone of this process interferes.
        found = (
            log_rows(records, limit=limit, **bounds)
            .withColumn("_at", iso_text(F.col("timestamp")))
            .collect()
        )
        if len(found) > limit:
            break
    page = found[:limit]
    cursor = None
    if len(found) > limit:
        cursor = Cursor(parse_instant(page[-1]["_at"]), page[-1]["id"]).encode()
    shown = [Row(**{k: v for k, v in row.asDict().items() if k != "_at"}) for row in page]
    return Page(shown, cursor)


def _starts(newest: datetime | None, params: dict) -> list[datetime | None]:
    """Lower time bounds to try in turn; None stands for the bound that was asked for."""
    if newest is None:
        return [None]
    latest = parse_instant(newest)
    if params.get("end") is not None:
        latest = min(latest, parse_instant(params["end"], "to"))
    if params.get("cursor") is not None:
        latest = min(latest, Cursor.decode(params["cursor"]).timestamp)
    asked = params.get("start")
    floor = None if asked is None else parse_instant(asked, "from")
    tries = [latest - back for back in LOOK_BACK]
    return [start for start in tries if floor is None or start > floor] + [None]


def list_issues(
    issues: DataFrame, *, service: str | None = None, severity: Levels = None
) -> DataFrame:
    """Issues by last sighting, newest first, at most 500."""
    clauses = filters.serves(service) + filters.level_is(severity)
    return (
        issues.where(filters.all_of(clauses))
        .select(
            "fingerprint",
            "sample_message",
            "severity_number",
            "event_count",
            "first_seen",
            "last_seen",
            "affected_services",
            F.lower("status").alias("status"),
            "regression",
        )
        .orderBy(F.desc("last_seen"), "fingerprint")
        .limit(MOST_ISSUES)
    )


def issue(issues: DataFrame, fingerprint: str) -> DataFrame:
    return issues.where(F.col("fingerprint") == fingerprint)
