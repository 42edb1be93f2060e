"""Severity names, numbers and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions import jsontext
from logloom.functions.text import trim

# Base number of each severity band.
TRACE, DEBUG, INFO, WARN, ERROR, FATAL = 1, 5, 9, 13, 17, 21

# Level names, matched without regard to case.
NAMES = {
    "trace": TRACE,
    "debug": DEBUG,
    "verbose": DEBUG,
    "info": INFO,
    "informational": INFO,
    "notice": INFO,
    "access": INFO,
    "warn": WARN,
    "warning": WARN,
    "error": ERROR,
    "err": ERROR,
    "fatal": FATAL,
    "critical": FATAL,
    "crit": FATAL,
    "alert": FATAL,
    "emerg": FATAL,
    "emergency": FATAL,
    "panic": FATAL,
}

# Numeric levels, read only under a declared convention.
CONVENTIONS = {
    "syslog": {0: FATAL, 1: FATAL, 2: FATAL, 3: ERROR, 4: WARN, 5: INFO, 6: INFO, 7: DEBUG},
    "pino": {10: TRACE, 20: DEBUG, 30: INFO, 40: WARN, 50: ERROR, 60: FATAL},
}

# Band names, from the highest base number down.
BANDS = (
    ("fatal", FATAL),
    ("error", ERROR),
    ("warn", WARN),
    ("info", INFO),
    ("debug", DEBUG),
    ("trace", TRACE),
)
UNKNOWN = "unknown"
MIN_LEVEL, MAX_LEVEL = 1, 24


def _lookup(table: dict, key: Column) -> Column:
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), key)


def _from_level(level: Column, convention: str | None) -> Column:
    if convention is None:
        return F.lit(None).cast("int")
    if convention not in CONVENTIONS:
        raise ValueError(f"unknown severity convention: {convention!r}")
    return F.when(
        level == F.floor(level), _lookup(CONVENTIONS[convention], level.try_cast("int"))
    )


def number_of_token(token: Column, convention: str | None = None) -> Column:
    """Severity number of a text token, NULL when it cannot be determined."""
    bare = trim(token)
    named = _lookup(NAMES, F.lower(bare))
    if convention is None:
        return named
    numeric = F.when(F.rlike(bare, F.lit(r"^-?[0-9]+\z")), bare.try_cast("double"))
    return F.coalesce(named, _from_level(numeric, convention))


def text_of_token(token: Column) -> Column:
    """The token as written, NULL when it is blank."""
    return F.when(trim(token) != "", token)


def normalize(value: Column, convention: str | None = None) -> Column:
    """VARIANT level to STRUCT<severity_number, severity_text>."""
    token = jsontext.string_value(value)
    level = jsontext.number_value(value)
    return from_parts(token, level, jsontext.short_numbers(F.to_json(value)), convention)


def from_parts(
    token: Column, level: Column, level_text: Column, convention: str | None = None
) -> Column:
    """Same from a level given as text, or as a number with its spelling."""
    number = F.when(token.isNotNull(), number_of_token(token, convention)).otherwise(
        _from_level(level, convention)
    )
    text = F.when(token.isNotNull(), text_of_token(token)).when(
        level.isNotNull(), level_text
    )
    return F.struct(
        number.cast("int").alias("severity_number"), text.alias("severity_text")
    )


def band(number: Column) -> Column:
    """Band name of a severity number; NULL is ``unknown``."""
    name = F.when(number.isNull(), UNKNOWN)
    for label, base in BANDS[:-1]:
        name = name.when(number >= base, label)
    return name.otherwise(BANDS[-1][0])


def levels_of_band(name: str) -> list[int | str]:
    """Level filter values a band name stands for."""
    if name == UNKNOWN:
        return [UNKNOWN]
    bases = dict(BANDS)
    if name not in bases:
        raise ValueError(f"unknown severity band: {name!r}")
    return list(range(bases[name], bases[name] + 4))
