"""Write records as source lines of each format.

Input columns: ``sequence`` (BIGINT), ``timestamp``, ``service_name``, ``severity``
(info, warn, error, debug or NULL), ``body``, ``trace_id``, ``host``; the last
two may be NULL. Members without a value are left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.times import iso_text

# Names of the levels in a LogEntry.
GCP_LEVELS = {"info": "INFO", "warn": "WARNING", "error": "ERROR", "debug": "DEBUG"}
PROJECT = "sample-project"


def _json(*fields: tuple[str, Column]) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields]))


def json_line() -> Column:
    return _json(
        ("@timestamp", iso_text(F.col("timestamp"))),
        ("service", F.col("service_name")),
        ("message", F.col("body")),
        ("host", F.col("host")),
        ("env", F.lit("production")),
        ("trace_id", F.col("trace_id")),
        ("level", F.col("severity")),
    )


def gcp_entry() -> Column:
    levels = F.create_map(*[F.lit(x) for pair in GCP_LEVELS.items() for x in pair])
    labels = F.struct(
        F.col("service_name").alias("service_name"), F.lit("us-central1").alias("location")
    )
    resource = F.struct(F.lit("cloud_run_revision").alias("type"), labels.alias("labels"))
    service = F.coalesce("service_name", F.lit("app"))
    return _json(
        ("logName", F.concat(F.lit(f"projects/{PROJECT}/logs/"), service, F.lit("%2Fstderr"))),
        ("timestamp", iso_text(F.col("timestamp"))),
        ("resource", resource),
        ("textPayload", F.col("body")),
        ("trace", F.concat(F.lit(f"projects/{PROJECT}/traces/"), F.col("trace_id"))),
        ("labels", F.when(F.col("host").isNotNull(), F.struct("host"))),
        ("severity", F.try_element_at(levels, F.col("severity"))),
    )


def cloudwatch_message() -> Column:
    """Plain text for even numbers and for events without a level, else an object."""
    plain = F.col("severity").isNull() | (F.col("sequence") % 2 == 0)
    structured = _json(("level", F.col("severity")), ("msg", F.col("body")))
    return F.when(plain, F.col("body")).otherwise(structured)


def _cloudwatch_place() -> tuple[tuple[str, Column], ...]:
    group = F.concat(F.lit("/aws/lambda/"), F.col("service_name"))
    stream = F.concat(F.lit("2026/09/09/[$LATEST]"), F.coalesce("host", F.lit("stream")))
    return (("logGroup", F.coalesce(group, F.lit("app"))), ("logStream", stream))


def cloudwatch_event_fields() -> tuple[tuple[str, Column], ...]:
    return (
        ("id", F.lpad((F.col("sequence") + 1).cast("string"), 56, "0")),
        ("timestamp", F.unix_millis("timestamp")),
        ("message", cloudwatch_message()),
    )


def cloudwatch_event() -> Column:
    return _json(*_cloudwatch_place(), *cloudwatch_event_fields())


RENDERERS = {
    "json-lines": json_line,
    "gcp-cloud-logging": gcp_entry,
    "aws-cloudwatch": cloudwatch_event,
}


def render(events, source_type: str):
    """Events as a DataFrame of lines, ready for ``write.text``."""
    if source_type not in RENDERERS:
        raise ValueError(f"no renderer for {source_type!r}; known: {', '.join(RENDERERS)}")
    return events.select(RENDERERS[source_type]().alias("value"))
