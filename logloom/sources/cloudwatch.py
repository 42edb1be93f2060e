"""AWS CloudWatch: one event per line, as left by envelope expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import schema
from logloom.functions import jsontext, severity
from logloom.functions.times import MAX_DATE_MILLIS
from logloom.sources import base

_SERVICE = r"^/aws/[^/]+/(.+)\z"


def _positive_millis(number: Column) -> Column:
    """Epoch ms of a positive whole number, NULL for anything else."""
    return F.when(
        (number > 0) & (number == F.floor(number)) & (number <= MAX_DATE_MILLIS),
        number.cast("bigint"),
    )


class AwsCloudWatch:
    source_type = "aws-cloudwatch"

    def score(self) -> Column:
        doc = F.col("doc")
        marked = (
            base.line_is_object()
            & jsontext.is_string(jsontext.member(doc, "logGroup"))
            & jsontext.is_string(jsontext.member(doc, "logStream"))
            & _positive_millis(
                jsontext.number_value(jsontext.member(doc, "timestamp"))
            ).isNotNull()
        )
        return F.coalesce(F.avg(F.coalesce(marked, F.lit(False)).cast("int")), F.lit(0.0))

    def parse(self, lines: DataFrame) -> DataFrame:
        doc = F.col("doc")
        time = jsontext.member(doc, "timestamp")
        read = base.with_document(lines)
        read = read.select(
            "arrival",
            "value",
            "doc",
            jsontext.number_value(time).alias("number"),
            base.shape_error(base.line_is_object()).alias("shape"),
            time.isNull().alias("timeless"),
            jsontext.string_value(jsontext.member(doc, "message")).alias("message"),
            jsontext.string_value(jsontext.member(doc, "logGroup")).alias("group"),
        ).select(
            "*",
            _positive_millis(F.col("number")).alias("millis"),
            # Only text that opens like an object can be a structured message.
            F.when(jsontext.starts_object(F.col("message")), F.col("message")).alias("inner"),
        )
        read = jsontext.with_parsed(read, "inner", "content").select(
            "arrival",
            "value",
            "doc",
            "millis",
            F.coalesce(
                F.col("shape"),
                F.when(F.col("timeless"), schema.MISSING_TIME),
                F.when(F.col("millis").isNull(), schema.INVALID_TIME),
            ).alias("error_code"),
            "message",
            "group",
            "content",
        )
        content = F.col("content")
        level = jsontext.member(content, "level")
        level = F.when(~jsontext.is_null_value(level), level)
        read = read.select(
            "*",
            severity.normalize(
                F.coalesce(level, jsontext.member(content, "severity"))
            ).alias("severity"),
        )
        body = F.when(content.isNotNull(), jsontext.canonical(content)).otherwise(
            F.coalesce(F.col("message"), F.lit(""))
        )
        service = F.regexp_extract(F.col("group"), _SERVICE, 1)
        return base.draft(
            base.settled(read),
            self.source_type,
            timestamp=F.timestamp_millis(F.col("millis")),
            body=body,
            severity_number=F.col("severity.severity_number"),
            severity_text=F.col("severity.severity_text"),
            service_name=F.when(service != "", service),
            attributes=self._attributes(doc),
        )

    def _attributes(self, doc: Column) -> Column:
        def text(key: str) -> Column:
            value = jsontext.member(doc, key)
            return F.when(jsontext.is_string(value), value)

        event_id = jsontext.member(doc, "id")
        present = F.map_filter(
            F.create_map(
                F.lit("id"),
                F.when(~jsontext.is_null_value(event_id), event_id),
                F.lit("logGroup"),
                text("logGroup"),
                F.lit("logStream"),
                text("logStream"),
            ),
            lambda _, value: value.isNotNull(),
        )
        return jsontext.short_numbers(F.to_json(present))
