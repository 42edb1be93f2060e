"""JSON Lines: one object per line, well-known keys under several names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import schema
from logloom.functions import jsontext, severity, times
from logloom.functions.text import is_blank, trim
from logloom.sources import base

# Accepted key names, most preferred first.
TIME_KEYS = ("timestamp", "@timestamp", "time", "ts")
SEVERITY_KEYS = ("level", "severity", "lvl")
STRING_KEYS = {
    "body": ("message", "msg", "body"),
    "service_name": ("service", "service_name", "logger"),
    "host": ("host", "hostname"),
    "environment": ("env", "environment"),
    "trace_id": ("trace_id", "traceId"),
    "span_id": ("span_id", "spanId"),
}
# Fixed value: what a mostly-JSON sample scores.
CONFIDENCE = 0.3


_TEXTS = [key for keys in STRING_KEYS.values() for key in keys]


def _first_present(texts: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_element_at(texts, F.lit(key)) for key in keys])


def _first_key(entries: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(
        *[F.when(F.map_contains_key(entries, key), key) for key in keys]
    )


def _first_instant(moments: Column) -> Column:
    """STRUCT<key, instant> of the first time member that yields an instant."""

    def read(member: Column) -> Column:
        text = trim(jsontext.string_value(member["value"]))
        number = jsontext.number_value(member["value"])
        return F.struct(
            member["key"].alias("key"),
            F.coalesce(times.from_text(text), times.from_epoch(number)).alias("instant"),
        )

    found = F.filter(F.transform(moments, read), lambda m: m["instant"].isNotNull())
    return F.get(found, 0)


class JsonLines:
    source_type = "json-lines"

    def score(self) -> Column:
        objects = F.count_if(base.line_is_object())
        lines = F.count_if(~is_blank(F.col("value")))
        return F.when(objects * 2 > lines, CONFIDENCE).otherwise(0.0)

    def parse(self, lines: DataFrame) -> DataFrame:
        # Each step names what the next one uses more than once.
        doc, entries = F.col("doc"), F.col("entries")
        passed = ["arrival", "value", "entries"]
        read = base.with_document(lines).select(
            "arrival",
            "value",
            jsontext.members(doc).alias("entries"),
            base.shape_error(base.line_is_object()).alias("error_code"),
        )
        read = read.select(
            *passed,
            "error_code",
            # Strings under the known names, blank ones left out.
            F.map_filter(
                F.transform_values(
                    F.map_filter(entries, lambda key, _: key.isin(_TEXTS)),
                    lambda _, value: jsontext.string_value(value),
                ),
                lambda _, text: ~is_blank(text),
            ).alias("texts"),
            # Time members that are there, most preferred first.
            F.filter(
                F.array(
                    *[
                        F.struct(
                            F.lit(key).alias("key"),
                            F.try_element_at(entries, F.lit(key)).alias("value"),
                        )
                        for key in TIME_KEYS
                    ]
                ),
                lambda member: member["value"].isNotNull(),
            ).alias("moments"),
            _first_key(entries, SEVERITY_KEYS).alias("level_key"),
        )
        texts, level, moments = F.col("texts"), F.col("level"), F.col("moments")
        first = F.get(moments, 0)
        read = read.select(
            *passed,
            "error_code",
            "texts",
            "moments",
            jsontext.string_value(first["value"]).alias("time_text"),
            jsontext.number_value(first["value"]).alias("time_number"),
            "level_key",
            F.try_element_at(entries, F.col("level_key")).alias("level"),
        ).select(
            "*",
            trim(F.col("time_text")).alias("time_token"),
            jsontext.string_value(level).alias("level_token"),
            jsontext.number_value(level).alias("level_number"),
        )
        read = read.select(
            *passed,
            "error_code",
            "texts",
            "moments",
            F.coalesce(
                times.from_text(F.col("time_token")), times.from_epoch(F.col("time_number"))
            ).alias("instant"),
            "level_key",
            severity.from_parts(
                F.col("level_token"),
                F.col("level_number"),
                jsontext.short_numbers(F.to_json(level)),
            ).alias("severity"),
        )
        # Most lines settle with their first time member; the others are only
        # looked at when it yields nothing.
        read = read.select(
            *passed,
            "error_code",
            "texts",
            F.when(
                F.col("instant").isNotNull(),
                F.struct(first["key"].alias("key"), F.col("instant").alias("instant")),
            )
            .when(F.size(moments) > 1, _first_instant(moments))
            .alias("moment"),
            "level_key",
            "severity",
        )
        level = F.col("severity")
        used_level = level["severity_number"].isNotNull() | level["severity_text"].isNotNull()
        read = read.select(
            *passed,
            "texts",
            F.col("moment.instant").alias("time"),
            "severity",
            F.array_compact(
                F.array(
                    F.col("moment.key"),
                    F.when(used_level, F.col("level_key")),
                    *[_first_key(texts, keys) for keys in STRING_KEYS.values()],
                    *[F.lit(name) for name in schema.TYPED_ATTRIBUTES],
                )
            ).alias("consumed"),
            F.coalesce(
                F.col("error_code"),
                F.when(F.col("moment").isNull(), schema.MISSING_TIME),
            ).alias("error_code"),
        )
        picked = {name: _first_present(texts, keys) for name, keys in STRING_KEYS.items()}
        picked["body"] = F.coalesce(picked["body"], F.lit(""))
        return base.draft(
            base.settled(read),
            self.source_type,
            timestamp=F.col("time"),
            severity_number=level["severity_number"],
            severity_text=level["severity_text"],
            attributes=jsontext.short_numbers(
                F.to_json(jsontext.without(F.col("entries"), F.col("consumed")))
            ),
            **picked,
        )
