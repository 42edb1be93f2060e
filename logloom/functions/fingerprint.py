"""Structural fingerprint of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import first_line
from logloom.functions.tokenizer import structure

# Separators of the hashed text.
UNIT, FIELD = "\x1f", "\x1e"


def pattern(body: Column) -> Column:
    """Structure of the first non-blank line: the message without its variables."""
    return structure(first_line(body))


def _field(label: str, value: Column) -> Column:
    present = F.concat(F.lit(f"{label}{UNIT}present{UNIT}"), value.cast("string"))
    return F.coalesce(present, F.lit(f"{label}{UNIT}absent"))


def fingerprint(
    body: Column,
    service_name: Column,
    severity_number: Column,
) -> Column:
    """SHA-1 over message structure, service and severity; absence is marked."""
    text = F.concat_ws(
        FIELD,
        pattern(body),
        _field("service", service_name),
        _field("severity", severity_number),
    )
    return F.sha1(text)


def record_id(*parts: Column) -> Column:
    """UUID-shaped id that is the same on every recomputation."""
    digest = F.sha2(F.concat_ws(UNIT, *[part.cast("string") for part in parts]), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, at, size) for at, size in cuts])
