"""Predicates of the record and issue queries, with their argument checks."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import severity
from logloom.functions.times import Window, instant_lit, parse_instant

# Fixed value: shorter search texts are ignored.
MIN_SEARCH = 3


def check_limit(limit: int, most: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= most:
        raise ValueError(f"limit must be a whole number from 1 to {most}: {limit!r}")
    return limit


def check_service(service: str | None) -> str | None:
    if service is not None and (not isinstance(service, str) or not service):
        raise ValueError("service must be a non-empty string")
    return service


def check_levels(levels: Iterable[int | str] | int | str | None) -> list[int | str]:
    """Level filter values: whole numbers 1 to 24 and ``unknown``."""
    if levels is None:
        return []
    values = [levels] if isinstance(levels, int | str) else list(levels)
    checked: list[int | str] = []
    for value in values:
        if value == severity.UNKNOWN:
            checked.append(value)
            continue
        try:
            number = int(str(value))
        except ValueError:
            number = 0
        if isinstance(value, bool) or not severity.MIN_LEVEL <= number <= severity.MAX_LEVEL:
            raise ValueError(f"level must be 1 to 24 or 'unknown': {value!r}")
        checked.append(number)
    return checked


def time_bounds(
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    column: str = "timestamp",
) -> list[Column]:
    """Half-open bounds on the raw column, so that they reach the file scan."""
    clauses = []
    if start is not None:
        clauses.append(F.col(column) >= instant_lit(parse_instant(start, "from")))
    if end is not None:
        clauses.append(F.col(column) < instant_lit(parse_instant(end, "to")))
    return clauses


def date_bounds(
    start: str | datetime | None = None, end: str | datetime | None = None
) -> list[Column]:
    """Bounds on the partition column that follow from time bounds."""
    clauses = []
    if start is not None:
        clauses.append(F.col("event_date") >= F.lit(parse_instant(start).date()))
    if end is not None:
        clauses.append(F.col("event_date") <= F.lit(parse_instant(end).date()))
    return clauses


def within(
    records: DataFrame, window: Window, column: str = "timestamp"
) -> DataFrame:
    """Rows of a half-open window; prunes date partitions where the table has them."""
    clauses = time_bounds(window.start, window.end, column)
    if "event_date" in records.columns and column == "timestamp":
        clauses += date_bounds(window.start, window.end)
    return records.where(all_of(clauses))


def level_is(
    levels: Iterable[int | str] | int | str | None, column: str = "severity_number"
) -> list[Column]:
    """Severity set; ``unknown`` stands for NULL, an empty set filters nothing."""
    values = check_levels(levels)
    if not values:
        return []
    numbers = [value for value in values if value != severity.UNKNOWN]
    clauses = []
    if numbers:
        clauses.append(F.col(column).isin(numbers))
    if severity.UNKNOWN in values:
        clauses.append(F.col(column).isNull())
    return [reduce(lambda a, b: a | b, clauses)]


def service_is(service: str | None) -> list[Column]:
    check_service(service)
    return [] if service is None else [F.col("service_name") == service]


def serves(service: str | None) -> list[Column]:
    """Issues that have been seen in a service."""
    check_service(service)
    return [] if service is None else [F.array_contains("affected_services", service)]


def body_contains(text: str | None) -> list[Column]:
    """Case-insensitive substring, ignored when the text is too short."""
    if text is None or len(text) < MIN_SEARCH:
        return []
    return [F.contains(F.lower("body"), F.lower(F.lit(text)))]


def after_cursor(moment: datetime, record_id: str) -> list[Column]:
    """Rows that come after a row in (timestamp desc, id desc) order.

    The first clause follows from the second; it is the one a file scan can use.
    """
    boundary = instant_lit(moment)
    return [
        F.col("timestamp") <= boundary,
        (F.col("timestamp") < boundary) | (F.col("id") < record_id),
    ]


def all_of(clauses: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def attribute_exists(key: str) -> Column:
    return _attribute(key).isNotNull()


def attribute_is(key: str, value: str | int | float | bool) -> Column:
    """Equality on one attribute; text matches text, numbers match numbers."""
    kind = {str: "string", bool: "boolean"}.get(type(value), "double")
    found = _attribute(key)
    same_type = {
        "string": F.schema_of_variant(found) == "STRING",
        "boolean": F.schema_of_variant(found) == "BOOLEAN",
        "double": ~F.schema_of_variant(found).isin("STRING", "BOOLEAN"),
    }[kind]
    return same_type & (F.try_variant_get(found, "$", kind) == F.lit(value))


def attributes_contain(wanted: dict) -> Column:
    """All given members are present with the given scalar values."""
    return all_of([attribute_is(key, value) for key, value in wanted.items()])


def _attribute(key: str) -> Column:
    # Bracket notation keeps dots and other signs in a key literal.
    quoted = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(
        F.try_parse_json(F.col("attributes")), f"$['{quoted}']", "variant"
    )
