"""GCP Cloud Logging: one LogEntry per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import schema
from logloom.functions import jsontext, severity, times
from logloom.sources import base

# Members of a LogEntry by required type.
STRINGS = ("logName", "timestamp", "severity", "textPayload", "insertId", "trace", "spanId")
OBJECTS = ("jsonPayload", "protoPayload", "httpRequest", "operation")

# The label that names the service, by resource type.
SERVICE_LABELS = {
    "cloud_run_revision": "service_name",
    "k8s_container": "container_name",
    "gce_instance": "instance_id",
    "gae_app": "module_id",
}
_TRACE = r"^projects/[^/]+/traces/(.+)\z"


def _string_map(value: Column) -> Column:
    """Absent, or an object that holds strings only."""
    entries = jsontext.entries_of(value)
    return value.isNull() | F.coalesce(
        F.forall(F.map_values(entries), jsontext.is_string), F.lit(False)
    )


def is_log_entry() -> Column:
    """Whether ``doc`` fits the LogEntry schema; unlisted members are allowed."""
    doc = F.col("doc")
    resource_type = jsontext.member(doc, "resource.type")
    typed = F.forall(
        F.map_entries(jsontext.members(doc)),
        lambda member: F.when(
            member["key"].isin(*STRINGS), jsontext.is_string(member["value"])
        )
        .when(
            member["key"].isin(*OBJECTS, "resource"),
            jsontext.is_object(member["value"]),
        )
        .otherwise(True),
    )
    return (
        base.line_is_object()
        & typed
        & (resource_type.isNull() | jsontext.is_string(resource_type))
        & _string_map(jsontext.member(doc, "resource.labels"))
        & _string_map(jsontext.member(doc, "labels"))
    )


class GcpCloudLogging:
    source_type = "gcp-cloud-logging"

    def score(self) -> Column:
        doc = F.col("doc")
        payload = F.coalesce(
            *[jsontext.member(doc, k) for k in ("jsonPayload", "textPayload", "protoPayload")]
        )
        marked = (
            is_log_entry()
            & jsontext.member(doc, "logName").isNotNull()
            & jsontext.member(doc, "timestamp").isNotNull()
            & payload.isNotNull()
        )
        return F.coalesce(F.avg(F.coalesce(marked, F.lit(False)).cast("int")), F.lit(0.0))

    def parse(self, lines: DataFrame) -> DataFrame:
        doc = F.col("doc")

        def text(key: str) -> Column:
            return jsontext.member(doc, key, "string")

        def mapped(key: str) -> Column:
            return jsontext.member(doc, key, "map<string,variant>")

        read = base.with_document(lines)
        read = read.withColumn("error_code", base.shape_error(is_log_entry()))
        valid = F.col("error_code").isNull()
        read = read.select(
            "arrival",
            "value",
            "doc",
            "error_code",
            F.when(valid, text("timestamp")).alias("time_text"),
            F.when(valid, mapped("jsonPayload")).alias("payload"),
            F.when(valid, mapped("resource.labels")).alias("resource_labels"),
            F.when(valid, mapped("labels")).alias("own_labels"),
            text("resource.type").alias("resource_type"),
            text("severity").alias("level"),
            text("trace").alias("trace"),
            F.when(
                valid & jsontext.member(doc, "jsonPayload").isNotNull(),
                F.get_json_object(F.col("value"), "$.jsonPayload"),
            ).alias("payload_text"),
        )
        labels_by_type = F.create_map(*[F.lit(x) for pair in SERVICE_LABELS.items() for x in pair])
        read = read.select(
            "*",
            times.from_iso(F.col("time_text")).alias("time"),
            F.try_element_at(labels_by_type, F.col("resource_type")).alias("service_label"),
            F.try_element_at(F.col("payload"), F.lit("message")).alias("message"),
        )
        body = F.coalesce(
            text("textPayload"),
            jsontext.string_value(F.col("message")),
            jsontext.short_numbers(F.col("payload_text")),
            F.lit(""),
        )
        trace = F.col("trace")
        trace_id = F.when(
            F.rlike(trace, F.lit(_TRACE)), F.regexp_extract(trace, _TRACE, 1)
        ).otherwise(trace)
        service = F.try_element_at(F.col("resource_labels"), F.col("service_label"))
        nothing = F.create_map().cast("map<string,variant>")
        read = read.select(
            "arrival",
            "value",
            "doc",
            "payload",
            "time",
            F.coalesce(
                "error_code", F.when(F.col("time").isNull(), schema.MISSING_TIME)
            ).alias("error_code"),
            body.alias("text"),
            F.col("level"),
            F.try_variant_get(service, "$", "string").alias("service"),
            trace_id.alias("trace"),
            # Labels of the resource without the one that names the service,
            # under the entry's own labels.
            jsontext.overlay(
                F.coalesce(
                    F.map_filter(
                        F.col("resource_labels"),
                        lambda k, _: ~k.eqNullSafe(F.col("service_label")),
                    ),
                    nothing,
                ),
                F.coalesce(F.col("own_labels"), nothing),
            ).alias("labels"),
        )
        return base.draft(
            base.settled(read),
            self.source_type,
            timestamp=F.col("time"),
            body=F.col("text"),
            severity_number=severity.number_of_token(F.col("level")),
            severity_text=severity.text_of_token(F.col("level")),
            service_name=F.col("service"),
            trace_id=F.col("trace"),
            span_id=text("spanId"),
            attributes=self._attributes(),
        )

    def _attributes(self) -> Column:
        """Attributes as JSON: payload, labels and request members, laid over in order."""
        top = [
            F.struct(F.lit(key).alias("key"), jsontext.member(F.col("doc"), key).alias("value"))
            for key in ("httpRequest", "operation", "insertId")
        ]
        label_entry = F.struct(
            F.lit("labels").alias("key"),
            F.to_variant_object(F.col("labels")).alias("value"),
        )
        extra = F.filter(
            F.array(F.when(F.size("labels") > 0, label_entry), *top),
            lambda entry: entry["value"].isNotNull(),
        )
        payload = F.coalesce(
            jsontext.without(F.col("payload"), ["message"]),
            F.create_map().cast("map<string,variant>"),
        )
        merged = jsontext.overlay(payload, F.map_from_entries(extra))
        return jsontext.short_numbers(
            F.to_json(jsontext.without(merged, list(schema.TYPED_ATTRIBUTES)))
        )
