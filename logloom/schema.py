"""Column names and types of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Reasons a line is rejected, in order of precedence.
EMPTY_LINE = "empty-line"
MALFORMED = "malformed-syntax"
UNRECOGNIZED = "unrecognized-shape"
MISSING_TIME = "missing-timestamp"
INVALID_TIME = "invalid-timestamp"
ERROR_CODES = (EMPTY_LINE, MALFORMED, UNRECOGNIZED, MISSING_TIME, INVALID_TIME)

# Attribute names that have a column of their own.
TYPED_ATTRIBUTES = ("serviceName", "host", "environment", "traceId", "spanId")

# Position of an event in the order of arrival: file, start of the split inside
# the file, row within the scan, event within an expanded envelope.
ARRIVAL = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("event", T.IntegerType()),
    ]
)

# What a source hands over for each line.
DRAFT_COLUMNS = (
    "arrival",
    "raw",
    "error_code",
    "timestamp",
    "body",
    "severity_number",
    "severity_text",
    "service_name",
    "host",
    "environment",
    "trace_id",
    "span_id",
    "attributes",
    "source_type",
)

LIST_COLUMNS = (
    "id",
    "timestamp",
    "observed_at",
    "severity_number",
    "severity_text",
    "body",
    "service_name",
    "host",
    "environment",
    "trace_id",
    "span_id",
    "source_type",
    "fingerprint",
)

RECORD_COLUMNS = LIST_COLUMNS + ("attributes", "raw", "import_job_id", "arrival")

# One row per line read, good or bad; ``error_code`` tells them apart.
LINES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("observed_at", T.TimestampType()),
        T.StructField("severity_number", T.IntegerType()),
        T.StructField("severity_text", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("import_job_id", T.StringType()),
        T.StructField("arrival", ARRIVAL),
        T.StructField("error_code", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("event_date", T.DateType()),
    ]
)

# Counts of records: per minute and issue, and per day, issue and host.
MINUTES = T.StructType(
    [
        T.StructField("minute", T.TimestampType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("severity_number", T.IntegerType()),
        T.StructField("total", T.LongType()),
        T.StructField("event_date", T.DateType()),
    ]
)
DAYS = T.StructType(
    [
        T.StructField("fingerprint", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("total", T.LongType()),
        T.StructField("event_date", T.DateType()),
    ]
)

# Issue states.
UNRESOLVED, RESOLVED, IGNORED = "unresolved", "resolved", "ignored"
STATUSES = (UNRESOLVED, RESOLVED, IGNORED)

ISSUES = T.StructType(
    [
        T.StructField("fingerprint", T.StringType()),
        T.StructField("sample_message", T.StringType()),
        T.StructField("severity_number", T.IntegerType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("affected_services", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("resolved_at", T.TimestampType()),
        T.StructField("regression", T.BooleanType()),
    ]
)

# Job states in order.
PENDING, RUNNING, COMPLETED, FAILED = "PENDING", "RUNNING", "COMPLETED", "FAILED"

JOBS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("storage_key", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("total_lines", T.LongType()),
        T.StructField("processed_lines", T.LongType()),
        T.StructField("parse_errors", T.LongType()),
        T.StructField("elapsed_ms", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
