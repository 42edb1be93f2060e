"""Registered queries: every operator run over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import corpus
from checks.corpus import shown
from logloom import schema
from logloom.functions import jsontext, severity, times, tokenizer
from logloom.functions.fingerprint import pattern
from logloom.functions.text import first_line, once
from logloom.functions.times import iso_text
from logloom.operators import analytics, filters, integrity, issues, ledger, listing, records
from logloom.plans import compaction, dashboards
from logloom.plans import ingest as ingest_plan
from logloom.plans.store import Store, bucket_of
from logloom.sources import base, lines as line_ops, registry
from logloom.streaming import ingest as streaming
from logloom.streaming.state import read_issues, start_issue_state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Windows the oracle repeats.
MINUTES = ("2024-01-10T00:00:00Z", "2024-01-10T02:00:00Z")
HOURS = ("2024-01-10T00:00:00Z", "2024-01-12T00:00:00Z")
DAYS = ("2024-01-05T00:00:00Z", "2024-01-25T00:00:00Z")
ODD = ("2024-01-10T00:00:30Z", "2024-01-10T00:07:30Z")
INVERTED = ("2024-01-12T00:00:00Z", "2024-01-10T00:00:00Z")
SPIKE = ("2024-01-10T03:00:00Z", "2024-01-10T06:00:00Z")
RAGGED = ("2024-01-05T07:11:13.250Z", "2024-01-24T21:03:59.125Z")
RAGGED_SPIKE = ("2024-01-10T03:00:20Z", "2024-01-10T07:00:50.500Z")
SPLIT = "2024-01-15T00:00:00Z"
NOW = "2024-01-20T06:00:00Z"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _services(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


def _draft_view(drafts: DataFrame) -> DataFrame:
    """Draft or line columns in a form that can be compared with SQL."""
    return drafts.select(
        F.col("arrival.row").alias("event_id"),
        "error_code",
        shown("timestamp"),
        "body",
        "severity_number",
        "severity_text",
        "service_name",
        "host",
        "environment",
        "trace_id",
        "span_id",
        "attributes",
        "raw",
        "source_type",
        "fingerprint",
    )


def _parsed(drafts: DataFrame) -> DataFrame:
    whole = records.assemble(drafts, corpus.OBSERVED_AT, F.lit(corpus.JOB))
    return _draft_view(whole).drop("raw")


# --- sources ------------------------------------------------------------------


@query
def line_meter(spark, sf_dir):
    """Lines and bytes of the landed files."""
    store = corpus.ingested(spark, sf_dir)
    landing = store.base.removesuffix("/store") + "/landing/*"
    scanned = line_ops.scan_lines(spark, landing)
    sizes = line_ops.meter(scanned, spark, landing)
    held = scanned.groupBy(F.col("arrival.file").alias("file")).agg(
        F.sum(F.octet_length("value") + 1).alias("held")
    )
    return (
        sizes.join(held, "file")
        .groupBy(F.regexp_extract("file", "file=([^/]+)/", 1).alias("service"))
        .agg(
            F.sum("total_lines").alias("total_lines"),
            F.sum(F.col("size_bytes") - F.col("held")).alias("bytes_not_in_lines"),
        )
    )


def _envelopes(spark, sf_dir) -> DataFrame:
    """Events of one user, at most 40 at a time, as one-line CloudWatch exports."""
    event = F.to_json(
        F.struct(
            F.col("sequence").cast("string").alias("id"),
            F.unix_millis("timestamp").alias("timestamp"),
            F.col("body").alias("message"),
            F.when(F.col("sequence") % 10 == 4, "own").alias("logStream"),
        )
    )
    # An event that is no object stands for its message.
    event = F.when(F.col("sequence") % 10 == 3, F.to_json(F.array("body"))).otherwise(event)
    chunk = F.floor(F.col("sequence") / 40)
    grouped = corpus.log_events(spark, sf_dir).groupBy("user_id", chunk.alias("chunk")).agg(
        F.min("sequence").alias("sequence"),
        F.sort_array(F.collect_list(F.struct("sequence", event.alias("event")))).alias("events"),
    )
    line = F.concat(
        F.lit('{"owner":"1","logGroup":"/aws/lambda/u'), F.col("user_id"),
        F.lit('","logStream":"s","logEvents":['),
        F.array_join(F.col("events.event"), ","), F.lit("]}"),
    )
    return grouped.select(corpus.arrival(F.lit("envelopes")), line.alias("value"))


@query
def expand_envelope(spark, sf_dir):
    expanded = line_ops.expand_envelopes(_envelopes(spark, sf_dir))
    return expanded.select(
        F.col("arrival.row").alias("envelope"),
        F.col("arrival.event").alias("position"),
        "value",
    )


@query
def expand_other_lines(spark, sf_dir):
    """Lines that are no envelopes go through unchanged."""
    lines = corpus.mixed_lines(spark, sf_dir).select("arrival", "value")
    expanded = line_ops.expand_envelopes(lines)
    return expanded.select(
        F.col("arrival.row").alias("event_id"),
        F.col("arrival.event").alias("position"),
        F.octet_length("value").alias("bytes"),
    ).groupBy("position").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("event_id").alias("events")
    )


@query
def head_sample(spark, sf_dir):
    lines = corpus.mixed_lines(spark, sf_dir).select("arrival", "value")
    return line_ops.head_sample(lines).select(
        F.col("arrival.file").alias("file"), F.col("arrival.row").alias("event_id")
    )


@query
def detect_format(spark, sf_dir):
    lines = corpus.mixed_lines(spark, sf_dir).select("arrival", "value")
    return registry.detect(lines).select(
        "file",
        "source_type",
        F.col("`gcp-cloud-logging`").alias("gcp"),
        F.col("`aws-cloudwatch`").alias("cloudwatch"),
        F.col("`json-lines`").alias("json_lines"),
    )


# --- parsers --------------------------------------------------------------------


@query
def parse_jsonlines(spark, sf_dir):
    return _parsed(registry.parse_as(corpus.lines(spark, sf_dir, "json-lines"), "json-lines"))


@query
def parse_gcp(spark, sf_dir):
    kind = "gcp-cloud-logging"
    return _parsed(registry.parse_as(corpus.lines(spark, sf_dir, kind), kind))


@query
def parse_cloudwatch(spark, sf_dir):
    kind = "aws-cloudwatch"
    return _parsed(registry.parse_as(corpus.lines(spark, sf_dir, kind), kind))


def _turn(n: int) -> Column:
    return F.col("sequence") % n


@query
def jsonlines_aliases(spark, sf_dir):
    """Key names, losing aliases, unusable values and leftovers in turn."""
    ms = F.unix_millis("timestamp")
    moment = (
        F.when(_turn(5) == 0, F.concat(F.lit('"timestamp":"'), iso_text(F.col("timestamp")), F.lit('"')))
        .when(_turn(5) == 1, F.concat(F.lit('"@timestamp":"nope","time":'), ms))
        .when(_turn(5) == 2, F.concat(F.lit('"ts":"'), ms, F.lit('"')))
        .when(_turn(5) == 3, F.concat(F.lit('"time":'), F.floor(ms / 1000)))
        .otherwise(F.lit('"timestamp":-5,"ts":true'))
    )
    body = (
        F.when(_turn(4) == 0, F.concat(F.lit('"message":"'), F.col("body"), F.lit('","msg":"other"')))
        .when(_turn(4) == 1, F.concat(F.lit('"message":"  ","msg":"'), F.col("body"), F.lit('"')))
        .when(_turn(4) == 2, F.concat(F.lit('"message":7,"body":"'), F.col("body"), F.lit('"')))
        .otherwise(F.lit('"msg":null'))
    )
    level = (
        F.when(_turn(7) == 0, '"level":"ERROR"')
        .when(_turn(7) == 1, '"level":null,"severity":"info"')
        .when(_turn(7) == 2, '"severity":" Warn "')
        .when(_turn(7) == 3, '"lvl":30')
        .when(_turn(7) == 4, '"level":"40","lvl":"error"')
        .when(_turn(7) == 5, '"severity":{"a":1}')
        .otherwise('"x":1.0')
    )
    service = (
        F.when(_turn(3) == 0, '"service":"a","logger":"b","serviceName":"c"')
        .when(_turn(3) == 1, '"service":"","service_name":"d","host":"h1","hostname":"h2"')
        .otherwise('"logger":"e","environment":"prod","traceId":"t","span_id":"s"')
    )
    line = F.concat(F.lit("{"), F.concat_ws(",", moment, body, level, service), F.lit("}"))
    lines = corpus.log_events(spark, sf_dir).select(
        corpus.arrival(F.lit("aliases")), line.alias("value")
    )
    return _parsed(registry.parse_as(lines, "json-lines")).drop("fingerprint")


@query
def gcp_variants(spark, sf_dir):
    """Payload kinds, resource types, labels and type errors in turn."""
    stamp = F.concat(F.lit('"timestamp":"'), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit('456Z"'))
    stamp = F.when(_turn(19) == 3, '"timestamp":""').when(_turn(19) == 4, '"logName":"x"').otherwise(stamp)
    kinds = ("cloud_run_revision", "k8s_container", "gce_instance", "gae_app", "pubsub_topic")
    labels = '"labels":{"service_name":"s1","container_name":"s2","instance_id":"s3","module_id":"s4","zone":"z"}'
    resource = F.lit("")
    for i, kind in enumerate(kinds):
        resource = F.when(_turn(6) == i, f'"resource":{{"type":"{kind}",{labels}}}').otherwise(resource)
    resource = F.when(_turn(6) == 5, '"labels":{"zone":"own"}').otherwise(resource)
    text = F.concat(F.lit('"textPayload":"'), F.col("body"), F.lit('"'))
    payload = (
        F.when(_turn(5) == 0, text)
        .when(
            _turn(5) == 1,
            F.concat(F.lit('"jsonPayload":{"message":"'), F.col("body"), F.lit('","n":'), F.col("user_id"), F.lit("}")),
        )
        .when(_turn(5) == 2, F.concat(F.lit('"jsonPayload":{"z":'), F.col("user_id"), F.lit('.0,"a":"1.0"}')))
        .when(_turn(5) == 3, F.concat(text, F.lit(',"jsonPayload":{"insertId":"low","host":"h"},"insertId":"i"')))
        .otherwise('"protoPayload":{"p":1},"httpRequest":{"status":500},"operation":{"id":"o"}')
    )
    wrong = F.when(_turn(17) == 2, '"severity":null').when(_turn(17) == 5, '"labels":{"a":1}').when(
        _turn(17) == 9, '"trace":"projects/p/traces/abc","spanId":"sp"'
    ).when(_turn(17) == 10, '"trace":"abc","severity":"CRITICAL"').otherwise('"extra":[1]')
    line = F.concat(F.lit("{"), F.concat_ws(",", stamp, F.nullif(resource, F.lit("")), payload, wrong), F.lit("}"))
    lines = corpus.log_events(spark, sf_dir).select(
        corpus.arrival(F.lit("variants")), line.alias("value")
    )
    return _parsed(registry.parse_as(lines, "gcp-cloud-logging")).drop("fingerprint")


@query
def cloudwatch_variants(spark, sf_dir):
    """Times, messages and groups a CloudWatch event may carry, in turn."""
    ms = F.unix_millis("timestamp").cast("string")
    moment = (
        F.when(_turn(8) == 0, F.concat(F.lit('"timestamp":"'), ms, F.lit('"')))
        .when(_turn(8) == 1, '"timestamp":null')
        .when(_turn(8) == 2, '"timestamp":0')
        .when(_turn(8) == 3, F.concat(F.lit('"timestamp":'), ms, F.lit(".5")))
        .when(_turn(8) == 4, F.concat(F.lit('"timestamp":'), ms, F.lit(".0")))
        .when(_turn(8) == 5, '"time":1')
        .otherwise(F.concat(F.lit('"timestamp":'), ms))
    )
    message = (
        F.when(_turn(9) == 0, '"message":""')
        .when(_turn(9) == 1, '"message":[1]')
        .when(_turn(9) == 2, '"message":"{\\"level\\":null,\\"severity\\":\\"WARNING\\",\\"b\\":2.50}"')
        .when(_turn(9) == 3, '"message":" {\\"z\\":{\\"y\\":1,\\"x\\":[]},\\"level\\":30} "')
        .when(_turn(9) == 4, '"message":"{\\"level\\":\\"error\\"} tail"')
        .when(_turn(9) == 5, '"message":"[1]"')
        .otherwise(F.concat(F.lit('"message":"ERROR '), F.col("body"), F.lit('"')))
    )
    place = (
        F.when(_turn(5) == 0, '"logGroup":"/aws/ecs/pay/worker","logStream":"i"')
        .when(_turn(5) == 1, '"logGroup":"custom","id":null')
        .when(_turn(5) == 2, '"logGroup":7,"id":9')
        .otherwise('"logGroup":"/aws/lambda","logStream":null,"id":"a"')
    )
    line = F.concat(F.lit("{"), F.concat_ws(",", moment, message, place), F.lit("}"))
    lines = corpus.log_events(spark, sf_dir).select(
        corpus.arrival(F.lit("variants")), line.alias("value")
    )
    return _parsed(registry.parse_as(lines, "aws-cloudwatch")).drop("fingerprint")


def _routed(spark, sf_dir) -> DataFrame:
    lines = corpus.mixed_lines(spark, sf_dir)
    drafts = registry.route(
        {
            kind: lines.where(F.col("kind") == kind).select("arrival", "value")
            for kind in registry.source_types()
        }
    )
    return records.assemble(drafts, corpus.OBSERVED_AT, F.lit(corpus.JOB))


@query
def parse_errors(spark, sf_dir):
    return records.error_counts(_routed(spark, sf_dir))


@query
def rejected_lines(spark, sf_dir):
    return records.rejects(_routed(spark, sf_dir)).select(
        F.col("arrival.row").alias("event_id"), "source_type", "error_code", "raw"
    )


@query
def run_totals(spark, sf_dir):
    lines = _routed(spark, sf_dir).withColumn("file", F.col("arrival.file"))
    return records.run_totals(lines, "file", "source_type")


# --- functions --------------------------------------------------------------------


@query
def severity_map(spark, sf_dir):
    """Level values of every kind, without and with a numeric convention."""
    levels = (
        '"ERROR"', '"  warn\\t"', '"Informational"', '"banana"', '""', '" "', '"30"', "30",
        "3", "3.5", "true", "null", '{"a":1}', '"-1"', '"access"', '"Panic"', "70",
    )
    choices = F.array(*[F.lit(x) for x in levels])
    events = corpus.table(spark, sf_dir, "events").select(
        "event_id", F.element_at(choices, (F.col("event_id") % len(levels) + 1).cast("int")).alias("json")
    )
    value = F.parse_json("json")
    shaped = events.select(
        "event_id",
        severity.normalize(value).alias("plain"),
        severity.normalize(value, "syslog").alias("syslog"),
        severity.normalize(value, "pino").alias("pino"),
    )
    return shaped.select(
        "event_id",
        F.col("plain.severity_number").alias("number"),
        F.col("plain.severity_text").alias("text"),
        F.col("syslog.severity_number").alias("syslog_number"),
        F.col("pino.severity_number").alias("pino_number"),
    )


@query
def severity_bands(spark, sf_dir):
    numbers = corpus.table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 25 > 0, F.col("event_id") % 25).cast("int").alias("number")
    )
    return numbers.groupBy("number", severity.band(F.col("number")).alias("band")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def instants(spark, sf_dir):
    """Time values of every accepted and refused spelling."""
    at, turn = F.col("timestamp"), F.col("sequence") % 12
    ms = F.unix_millis(at)
    text = (
        F.when(turn == 0, ms.cast("string"))
        .when(turn == 1, F.floor(ms / 1000).cast("string"))
        .when(turn == 2, F.concat(F.floor(ms / 1000).cast("string"), F.lit(".25")))
        .when(turn == 3, iso_text(at))
        .when(turn == 4, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .when(turn == 5, F.date_format(at, "yyyy-MM-dd'T'HH:mm'+02:00'"))
        .when(turn == 6, F.date_format(at, "yyyy-MM-dd"))
        .when(turn == 7, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'999-0130'"))
        .when(turn == 8, "-5")
        .when(turn == 9, "99999999999999999")
        .when(turn == 10, F.date_format(at, "yyyy/MM/dd"))
        .otherwise(F.date_format(at, "yyyy-MM'-31T24:00Z'"))
    )
    return corpus.log_events(spark, sf_dir).select(
        F.col("sequence").alias("event_id"), text.alias("text")
    ).select("event_id", iso_text(times.from_text(F.col("text"))).alias("instant"))


@query
def canonical_json(spark, sf_dir):
    text = F.concat(
        F.lit('{"z":'), F.col("user_id"), F.lit(',"a":{"y":1.0,"b":["1.0",'), F.col("event_id"),
        F.lit(',{"d":null,"c":-2.50}]},"z":"'), F.col("event_type"), F.lit('"}'),
    )
    texts = corpus.table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return jsontext.with_parsed(texts, "text", "doc").select(
        "event_id", jsontext.canonical(F.col("doc")).alias("json")
    )


@query
def first_lines(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id", first_line(F.col("text")).alias("line")
    )


@query
def span_kinds(spark, sf_dir):
    spans = corpus.log_events(spark, sf_dir).select(
        F.explode(tokenizer.tokenize(F.col("body"))).alias("span")
    )
    return spans.groupBy(
        F.col("span.type").alias("type"), F.col("span.kind").alias("kind")
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def span_kinds_all(spark, sf_dir):
    """Structure and values of messages with each of the nine kinds."""
    message = corpus.kinds_message()
    spans = F.filter(tokenizer.tokenize(message), lambda s: s["type"] == "variable")
    return corpus.log_events(spark, sf_dir).select(
        F.col("sequence").alias("event_id"),
        F.replace(tokenizer.structure(message), F.lit("\x1f"), F.lit("|")).alias("structure"),
        F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit("="), s["value"])), ";").alias("found"),
    )


@query
def spans_rebuild_text(spark, sf_dir):
    """Whole free texts: the spans of a text add up to the text."""
    parts = []
    for name, column in (("documents", "text"), ("conversations", "text"), ("pages", "html")):
        parts.append(
            corpus.table(spark, sf_dir, name).select(
                F.lit(name).alias("source"), F.col(column).alias("text")
            )
        )
    texts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    spans = tokenizer.tokenize(F.col("text"))
    rebuilt = F.array_join(F.transform(spans, lambda s: s["value"]), "")
    return (
        texts.select("source", (rebuilt == F.col("text")).alias("same"))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("texts"), F.count_if(~F.col("same")).alias("changed"))
    )


@query
def fingerprints(spark, sf_dir):
    return corpus.canonical_records(spark, sf_dir).select(
        F.col("arrival.row").alias("event_id"), "id", "fingerprint"
    )


@query
def distinct_fingerprints(spark, sf_dir):
    return records.fingerprints(corpus.canonical_records(spark, sf_dir))


# --- dashboard ------------------------------------------------------------------------


def _rate(window: tuple[str, str]) -> Query:
    def run(spark, sf_dir):
        rate = analytics.error_rate(corpus.canonical_records(spark, sf_dir), *window)
        return rate.select(shown("bucket"), "total", "errors", "ratio")

    return run


for _name, _window in (
    ("minute", MINUTES), ("hour", HOURS), ("day", DAYS), ("odd", ODD), ("inverted", INVERTED),
):
    QUERIES[f"error_rate_{_name}"] = _rate(_window)


@query
def by_service(spark, sf_dir):
    return analytics.by_service(corpus.canonical_records(spark, sf_dir), *DAYS)


def _summary_view(summary: DataFrame) -> DataFrame:
    return summary.withColumn("first_seen", iso_text(F.col("first_seen"))).withColumn(
        "services", F.array_join("services", ",")
    )


@query
def top_issues(spark, sf_dir):
    found = corpus.canonical_records(spark, sf_dir)
    known = corpus.canonical_issues(spark, sf_dir)
    return _summary_view(analytics.top_issues(found, known, *DAYS))


@query
def top_issues_limit(spark, sf_dir):
    found = corpus.canonical_records(spark, sf_dir)
    known = corpus.canonical_issues(spark, sf_dir)
    return _summary_view(analytics.top_issues(found, known, *HOURS, limit=3))


@query
def spikes(spark, sf_dir):
    found = corpus.canonical_records(spark, sf_dir)
    known = corpus.canonical_issues(spark, sf_dir)
    return _summary_view(analytics.spikes(found, known, *SPIKE))


@query
def new_issues(spark, sf_dir):
    known = corpus.canonical_issues(spark, sf_dir)
    return _summary_view(analytics.new_issues(known, "2024-01-01T02:00:00Z", SPLIT))


# The same from the counts that imports keep, for windows that cut minutes and days.


@query
def rollup_error_rate(spark, sf_dir):
    rate = dashboards.error_rate(corpus.canonical_store(spark, sf_dir), *RAGGED)
    return rate.select(shown("bucket"), "total", "errors", "ratio")


@query
def rollup_by_service(spark, sf_dir):
    return dashboards.by_service(corpus.canonical_store(spark, sf_dir), *RAGGED)


@query
def rollup_top_issues(spark, sf_dir):
    return _summary_view(dashboards.top_issues(corpus.canonical_store(spark, sf_dir), *RAGGED))


@query
def rollup_spikes(spark, sf_dir):
    return _summary_view(dashboards.spikes(corpus.canonical_store(spark, sf_dir), *RAGGED_SPIKE))


@query
def rollup_timeline(spark, sf_dir):
    store = corpus.canonical_store(spark, sf_dir)
    return dashboards.timeline(store, _error_of("svc-1"), *RAGGED).select(shown("bucket"), "total")


@query
def rollup_blast_radius(spark, sf_dir):
    spread = dashboards.blast_radius(corpus.canonical_store(spark, sf_dir), *RAGGED)
    return spread.withColumn("pattern", F.translate("pattern", "\x1f", "|"))


@query
def rollup_of_runs(spark, sf_dir):
    """Counts per service of a store written in five runs: as they are, merged, and merged alone."""
    store = corpus.store_of_days(spark, sf_dir, CUTS)
    folder = corpus.new_folder(spark)
    phases = (
        ("before", lambda: None),
        ("after", lambda: compaction.compact(store)),
        ("vacuumed", lambda: compaction.vacuum(store)),
    )
    for name, step in phases:
        step()
        found = dashboards.by_service(store, *RAGGED).withColumn("phase", F.lit(name))
        found.write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


# --- lists -------------------------------------------------------------------------------


def _list_view(rows: DataFrame) -> DataFrame:
    return rows.withColumn("timestamp", iso_text(F.col("timestamp"))).withColumn(
        "observed_at", iso_text(F.col("observed_at"))
    )


@query
def list_logs_page1(spark, sf_dir):
    return _list_view(listing.log_rows(corpus.canonical_records(spark, sf_dir)))


@query
def list_logs_page2(spark, sf_dir):
    found = corpus.canonical_records(spark, sf_dir)
    first = listing.list_logs(found, limit=50)
    return _list_view(listing.log_rows(found, limit=50, cursor=first.next_cursor))


@query
def list_logs_filtered(spark, sf_dir):
    return _list_view(
        listing.log_rows(
            corpus.canonical_records(spark, sf_dir),
            level=[*severity.levels_of_band("error"), 13, "unknown"],
            service="svc-3",
            start=DAYS[0],
            end=DAYS[1],
            limit=200,
        )
    )


@query
def list_logs_search(spark, sf_dir):
    return _list_view(
        listing.log_rows(
            corpus.canonical_records(spark, sf_dir), q="PURCHASE K=1", level="13", limit=100
        )
    )


@query
def list_logs_unknown(spark, sf_dir):
    """Level unknown alone; the two-letter search text is ignored."""
    found = corpus.canonical_records(spark, sf_dir)
    return _list_view(listing.log_rows(found, level="unknown", q="zz", limit=10))


@query
def count_logs_by_filter(spark, sf_dir):
    """Each predicate on its own, counted over the whole table."""
    found = corpus.canonical_records(spark, sf_dir)
    sets = {
        "level": filters.level_is([17, 5]),
        "unknown": filters.level_is("unknown"),
        "service": filters.service_is("svc-0"),
        "search": filters.body_contains("from 10.0.1"),
        "from": filters.time_bounds(DAYS[0], None),
        "to": filters.time_bounds(None, DAYS[0]),
        "inverted": filters.time_bounds(*INVERTED),
        "cursor": filters.after_cursor(
            times.parse_instant(SPLIT), "88888888-8888-8888-8888-888888888888"
        ),
        "attribute_exists": [filters.attribute_exists("user")],
        "attribute_missing": [filters.attribute_exists("id")],
        "attribute_text": [filters.attribute_is("kind", "click")],
        "attribute_number": [filters.attributes_contain({"uid": 7, "kind": "view"})],
        "attribute_type": [filters.attribute_is("uid", "7")],
    }
    counted = found.agg(
        *[F.count_if(filters.all_of(clauses)).alias(name) for name, clauses in sets.items()]
    )
    return counted.unpivot([], list(sets), "filter", "n")


def _issue_view(found: DataFrame) -> DataFrame:
    return found.withColumns(
        {
            "first_seen": iso_text(F.col("first_seen")),
            "last_seen": iso_text(F.col("last_seen")),
            "affected_services": F.array_join("affected_services", ","),
        }
    )


@query
def list_issues(spark, sf_dir):
    return _issue_view(listing.list_issues(corpus.canonical_issues(spark, sf_dir)))


@query
def list_issues_filtered(spark, sf_dir):
    known = corpus.canonical_issues(spark, sf_dir)
    return _issue_view(
        listing.list_issues(known, service="svc-2", severity=[17, "unknown"])
    )


@query
def issue_lookup(spark, sf_dir):
    """One issue by its key."""
    known = corpus.canonical_issues(spark, sf_dir)
    return _issue_view(listing.issue(known, _error_of("svc-1"))).drop("resolved_at")


def _error_of(service: str) -> str:
    """Fingerprint of the error events of a service, from its definition."""
    us, rs = "\x1f", "\x1e"
    number = f"{us}number{us}"
    text = f"user {number} error k={number} value {number} from {us}ipv4{us}"
    whole = f"{text}{rs}service{us}present{us}{service}{rs}severity{us}present{us}17"
    return hashlib.sha1(whole.encode()).hexdigest()


# --- issues --------------------------------------------------------------------------------


@query
def issue_fold(spark, sf_dir):
    return _issue_view(corpus.canonical_issues(spark, sf_dir)).drop("resolved_at")


@query
def issue_services(spark, sf_dir):
    """Occurrences fed directly, with many services per issue, in order of arrival."""
    fed = corpus.log_events(spark, sf_dir).select(
        F.col("event_type").alias("fingerprint"),
        F.col("body").alias("message"),
        "severity_number",
        "service_name",
        F.col("timestamp").alias("occurred_at"),
        # Arrival runs against the clock.
        F.struct(
            F.lit("f").alias("file"), F.lit(0).cast("bigint").alias("block"),
            (-F.col("sequence")).alias("row"), F.lit(0).alias("event"),
        ).alias("arrival"),
    )
    return _issue_view(issues.fold(fed))


@query
def issue_merge(spark, sf_dir):
    """Second half of the month on top of the first; part of the issues had been closed."""
    found = corpus.canonical_records(spark, sf_dir)
    early = found.where(filters.all_of(filters.time_bounds(None, SPLIT)))
    late = found.where(filters.all_of(filters.time_bounds(SPLIT, None)))
    stored = issues.opened(issues.fold(records.occurrences(early)))
    stored = stored.withColumns(
        {
            "status": F.when(F.col("severity_number") == 17, schema.RESOLVED)
            .when(F.col("severity_number") == 13, schema.IGNORED)
            .otherwise(F.col("status")),
            "resolved_at": F.when(F.col("severity_number") >= 13, F.col("last_seen")),
        }
    )
    merged = issues.upsert(stored, records.occurrences(late))
    return _issue_view(merged).withColumn("resolved_at", iso_text(F.col("resolved_at")))


def _acted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    events = corpus.table(spark, sf_dir, "events")
    action = (
        F.when(F.col("event_type").isin("click", "purchase"), issues.RESOLVE)
        .when(F.col("event_type").isin("error", "signup"), issues.IGNORE)
        .otherwise(issues.REOPEN)
    )
    actions = events.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("fingerprint"),
        action.alias("action"),
        F.col("ts").cast("timestamp").alias("at"),
    )
    # The first event of a user opens the issue, unless it is an error.
    first = F.col("first_type")
    known = (
        events.groupBy("user_id")
        .agg(
            F.min_by("event_type", "event_id").alias("first_type"),
            F.min("ts").cast("timestamp").alias("first_seen"),
        )
        .where(first != "error")
        .select(
            F.concat(F.lit("u"), F.col("user_id")).alias("fingerprint"),
            F.when(first == "view", schema.IGNORED)
            .when(first == "purchase", schema.RESOLVED)
            .otherwise(schema.UNRESOLVED)
            .alias("status"),
            F.when(first.isin("view", "purchase"), F.col("first_seen")).alias("resolved_at"),
            (first == "click").alias("regression"),
        )
    )
    return issues.apply_actions(known, actions)


@query
def issue_actions(spark, sf_dir):
    changed, _ = _acted(spark, sf_dir)
    return changed.withColumn("resolved_at", F.date_format("resolved_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query
def issue_actions_refused(spark, sf_dir):
    _, refused = _acted(spark, sf_dir)
    return refused.groupBy("fingerprint", "action", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def regressions(spark, sf_dir):
    found = corpus.canonical_records(spark, sf_dir)
    early = found.where(filters.all_of(filters.time_bounds(None, SPLIT)))
    late = found.where(filters.all_of(filters.time_bounds(SPLIT, None)))
    closed = issues.opened(issues.fold(records.occurrences(early))).withColumn(
        "status", F.lit(schema.RESOLVED)
    )
    return _summary_view(
        analytics.regressions(issues.upsert(closed, records.occurrences(late)))
    )


@query
def stored_regressions(spark, sf_dir):
    """Issues resolved in the store that came back with a later import."""
    return _summary_view(analytics.regressions(corpus.resolved_store(spark, sf_dir, SPLIT).issues()))


@query
def blast_radius(spark, sf_dir):
    spread = analytics.blast_radius(corpus.canonical_records(spark, sf_dir), *DAYS)
    return spread.withColumn("pattern", F.translate("pattern", "\x1f", "|"))


@query
def issue_timeline(spark, sf_dir):
    found = corpus.canonical_records(spark, sf_dir)
    line = analytics.timeline(found, _error_of("svc-1"), *DAYS)
    return line.select(shown("bucket"), "total")


@query
def orphan_records(spark, sf_dir):
    store = corpus.ingested(spark, sf_dir)
    stray = integrity.records_without_issue(store.records(), store.issues())
    jobless = integrity.records_without_job(store.records(), store.jobs())
    found = stray.select(F.lit("issue").alias("lacks"), "records").unionByName(
        jobless.select(F.lit("job").alias("lacks"), "records")
    )

    def lacking(what: str) -> Column:
        counted = F.sum(F.when(F.col("lacks") == what, F.col("records")))
        return F.coalesce(counted, F.lit(0)).cast("bigint").alias(f"without_{what}")

    return found.agg(lacking("issue"), lacking("job"))


# --- jobs -----------------------------------------------------------------------------------


def _jobs(spark, sf_dir) -> DataFrame:
    """One import job per event, in every state."""
    n, k = F.col("event_id"), F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    status = (
        F.when(F.col("event_type") == "error", schema.FAILED)
        .when(F.col("event_type") == "signup", schema.PENDING)
        .when(F.col("event_type") == "view", schema.RUNNING)
        .otherwise(schema.COMPLETED)
    )
    at = F.date_trunc("millisecond", F.col("ts").cast("timestamp"))
    events = corpus.table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("job-"), F.lpad(n.cast("string"), 12, "0")).alias("id"),
        F.lit("r").alias("run"),
        F.concat(F.lit("f"), F.col("user_id")).alias("filename"),
        F.lit("k").alias("storage_key"),
        (n * 10).alias("size_bytes"),
        F.when(n % 2 == 0, "json-lines").alias("source_type"),
        status.alias("status"),
        F.when(n % 5 > 0, n % 1000).alias("total_lines"),
        (n * k % 1200).alias("processed_lines"),
        (n * k % 1200 % 7).alias("parse_errors"),
        F.when(n % 9 > 0, k * 25).alias("elapsed_ms"),
        F.when(status == schema.FAILED, "disk full").alias("error"),
        at.alias("created_at"),
        F.when(status.isin(schema.FAILED, schema.COMPLETED), at).alias("finished_at"),
        F.lit(1).alias("step"),
        at.alias("updated_at"),
    )


@query
def import_status(spark, sf_dir):
    status = ledger.import_status(_jobs(spark, sf_dir))
    return status.withColumn("created_at", iso_text(F.col("created_at"))).withColumn(
        "finished_at", iso_text(F.col("finished_at"))
    )


@query
def import_progress(spark, sf_dir):
    return ledger.progress(ledger.import_status(_jobs(spark, sf_dir)))


@query
def list_imports(spark, sf_dir):
    found = ledger.list_imports(_jobs(spark, sf_dir))
    return found.withColumn("created_at", iso_text(F.col("created_at")))


@query
def job_transitions(spark, sf_dir):
    """Ledger of all transitions of the jobs, cut back to the latest row of each."""
    jobs = _jobs(spark, sf_dir)
    at = F.col("created_at")
    opened = ledger.transition(jobs, schema.PENDING, at)
    rows = opened.unionByName(
        ledger.transition(jobs.where("status <> 'PENDING'"), schema.RUNNING, at)
    )
    rows = rows.unionByName(
        ledger.transition(
            jobs.where("status = 'RUNNING'"), schema.RUNNING, at, progress=True,
            processed_lines=F.col("processed_lines") + 1,
        )
    )
    for status in (schema.COMPLETED, schema.FAILED):
        rows = rows.unionByName(
            ledger.transition(jobs.where(F.col("status") == status), status, at)
        )
    return ledger.latest(rows).groupBy("status", "step").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("processed_lines").alias("processed")
    )


# --- import from files -------------------------------------------------------------------------


def _service_of_file(path: Column) -> Column:
    return F.regexp_extract(path, "file=([^/]+)/", 1)


@query
def ingest_records(spark, sf_dir):
    found = corpus.ingested(spark, sf_dir).records()
    return found.select(
        F.regexp_extract("body", "user ([0-9]+) ", 1).alias("user"),
        shown("timestamp"),
        "body",
        "severity_number",
        "severity_text",
        "service_name",
        "host",
        "environment",
        "source_type",
        "fingerprint",
        "attributes",
        F.col("event_date").cast("string").alias("event_date"),
    ).drop("user")


@query
def ingest_rejects(spark, sf_dir):
    found = corpus.ingested(spark, sf_dir).rejects()
    return found.groupBy("source_type", "error_code", "raw").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def ingest_issues(spark, sf_dir):
    return _issue_view(corpus.ingested(spark, sf_dir).issues()).drop("resolved_at")


@query
def ingest_jobs(spark, sf_dir):
    jobs = ledger.import_status(corpus.ingested(spark, sf_dir).jobs())
    keyed = jobs.join(
        corpus.ingested(spark, sf_dir).jobs().select("id", "storage_key"), "id"
    )
    return keyed.groupBy(_service_of_file(F.col("storage_key")).alias("service"), "status").agg(
        F.sum("total_lines").alias("total_lines"),
        F.sum("processed_lines").alias("processed_lines"),
        F.sum("parse_errors").alias("parse_errors"),
        F.sum("ingested_records").alias("ingested_records"),
    )


@query
def ingest_odd_names(spark, sf_dir):
    """Every file is read once, whatever its folder is called."""
    store = corpus.odd_names(spark, sf_dir)
    service = F.regexp_extract("storage_key", "(svc-[0-6]|none)/[^/]*$", 1).alias("service")
    jobs = store.jobs().select("id", service, F.lower("status").alias("status"), "processed_lines")
    good = store.records().groupBy(F.col("import_job_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    bad = store.rejects().groupBy(F.col("import_job_id").alias("id")).agg(F.count(F.lit(1)).alias("m"))
    return (
        jobs.join(good, "id", "left")
        .join(bad, "id", "left")
        .groupBy("service", "status")
        .agg(
            F.sum("processed_lines").alias("lines"),
            F.sum(F.coalesce("n", F.lit(0))).alias("records"),
            F.sum(F.coalesce("m", F.lit(0))).alias("rejects"),
        )
    )


@query
def ingest_envelopes(spark, sf_dir):
    """Events of envelopes, landed as files and imported."""
    return corpus.envelope_store(spark, sf_dir).records().groupBy("service_name").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("arrival.file", "arrival.row").alias("envelopes"),
        F.min("body").alias("first_body"),
        F.max("body").alias("last_body"),
        iso_text(F.min("timestamp")).alias("first_seen"),
        iso_text(F.max("timestamp")).alias("last_seen"),
    )


@query
def reprocess(spark, sf_dir):
    """Stored lines parsed again; good and bad ones come out as before."""
    drafts = ingest_plan.reprocess(corpus.ingested(spark, sf_dir))
    return drafts.groupBy("source_type", "error_code").agg(
        F.count(F.lit(1)).alias("n"), F.count("body").alias("bodies")
    )


@query
def reprocess_issues(spark, sf_dir):
    """Issues of the stored lines, parsed, stored and folded again."""
    again = ingest_plan.reprocess_into(
        corpus.ingested(spark, sf_dir), f"{corpus.new_folder(spark)}/store", corpus.OBSERVED_AT
    )
    return _issue_view(again.issues()).drop("resolved_at")


@query
def stream_issues(spark, sf_dir):
    """The same events as a stream of files: they arrive in two waves, one batch each."""
    folder = corpus.new_folder(spark)
    waves = (filters.time_bounds(None, SPLIT), filters.time_bounds(SPLIT, None))
    for n, bounds in enumerate(waves):
        corpus.write_landing(
            spark, sf_dir, f"{folder}/landing/{n}", filters.all_of(bounds)
        )
        streaming.start_import(
            spark, f"{folder}/landing/*/*", f"{folder}/store", f"{folder}/progress",
            now=corpus.OBSERVED_AT,
        ).awaitTermination()
    return _issue_view(Store(spark, f"{folder}/store").issues()).drop("resolved_at")


@query
def stream_batches(spark, sf_dir):
    """The same files in batches of three of eight; the size of a batch changes no issue."""
    folder = corpus.new_folder(spark)
    corpus.write_landing(spark, sf_dir, f"{folder}/landing")
    # A service has more files where there are more events, not the stream more batches.
    files = line_ops.file_sizes(spark, f"{folder}/landing/*").count()
    streaming.start_import(
        spark, f"{folder}/landing/*", f"{folder}/store", f"{folder}/progress",
        max_files_per_batch=max(3, -(-3 * files // len(corpus.SERVICES))), now=corpus.OBSERVED_AT,
    ).awaitTermination()
    return _issue_view(Store(spark, f"{folder}/store").issues()).drop("resolved_at")


@query
def forced_type(spark, sf_dir):
    """All lines of all formats taken as JSON Lines."""
    lines = corpus.mixed_lines(spark, sf_dir).select("arrival", "value")
    drafts = registry.parse_as(lines, "json-lines")
    return drafts.groupBy("error_code", "source_type").agg(F.count(F.lit(1)).alias("n"))


@query
def time_presets(spark, sf_dir):
    """Records in each named range before a moment; an unknown name is a day."""
    found = corpus.canonical_records(spark, sf_dir)
    windows = {name: times.time_range(name, NOW) for name in ("1h", "24h", "7d", "30d", "ever")}
    windows["custom"] = times.time_range("custom", NOW, *HOURS)
    return found.agg(
        *[
            F.count_if(
                (F.col("timestamp") >= times.instant_lit(w.start))
                & (F.col("timestamp") < times.instant_lit(w.end))
            ).alias(f"in_{name}")
            for name, w in windows.items()
        ]
    )


@query
def render_lines(spark, sf_dir):
    """Rendered lines hold what the events hold, in each format."""
    parts = []
    for kind in registry.source_types():
        lines = corpus.lines(spark, sf_dir, kind, damaged=False)
        parts.append(
            lines.select(
                F.lit(kind).alias("source_type"),
                F.col("arrival.row").alias("event_id"),
                F.md5(F.col("value").cast("binary")).alias("digest"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- the store over time -----------------------------------------------------


@query
def ingest_bad_file(spark, sf_dir):
    """A file that cannot be read fails alone; the others keep their lines."""
    store = corpus.partly_readable(spark, sf_dir)
    service = F.regexp_extract("storage_key", "file=([^/]+)/", 1).alias("service")
    jobs = store.jobs().select("id", service, F.lower("status").alias("status"), "processed_lines", "error")
    good = store.records().groupBy(F.col("import_job_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return (
        jobs.join(good, "id", "left")
        .groupBy("service", "status")
        .agg(
            F.coalesce(F.sum("processed_lines"), F.lit(0)).alias("lines"),
            F.sum(F.coalesce("n", F.lit(0))).alias("records"),
            F.max(F.col("error").isNotNull()).alias("explained"),
        )
    )


@query
def progress_rows(spark, sf_dir):
    """What the ledger said of each job before it was closed; counts before that only rise."""
    store = corpus.partly_readable(spark, sf_dir)
    rows = store.transitions()
    before = ledger.latest(rows.where(F.col("step") == 2))
    service = F.regexp_extract("storage_key", "file=([^/]+)/", 1).alias("service")
    counted = store.progress().agg(F.max("lines")).first()[0] or 0
    total = rows.where(F.col("status") == schema.COMPLETED).agg(F.sum("processed_lines")).first()[0]
    return before.groupBy(service).agg(
        F.sum("processed_lines").alias("lines"),
        F.sum("parse_errors").alias("errors"),
        F.lower(F.max("status")).alias("status"),
        F.lit(counted <= total).alias("steady"),
    )


CUTS = ["2024-01-03", "2024-01-07", "2024-01-12", "2024-01-20"]


@query
def compacted_store(spark, sf_dir):
    """Records, issues and runs before and after compaction, and after old files are gone."""
    store = corpus.store_of_days(spark, sf_dir, CUTS)
    folder = corpus.new_folder(spark)
    states = []

    def state(phase):
        path = f"{folder}/{len(states)}"
        per_day = store.records().groupBy(F.col("event_date").cast("string").alias("day")).agg(
            F.count(F.lit(1)).alias("records"),
            F.count_distinct("fingerprint").alias("fingerprints"),
            F.sum(F.coalesce("severity_number", F.lit(0))).alias("levels"),
        )
        figures = {
            "phase": F.lit(phase),
            "runs": F.lit(store.runs().count()),
            "events": F.lit(store.issues().agg(F.sum("event_count")).first()[0]),
        }
        per_day.withColumns(figures).write.parquet(path)
        states.append(path)

    state("before")
    compaction.compact(store)
    state("after")
    compaction.vacuum(store)
    state("vacuumed")
    return spark.read.parquet(*states)


@query
def issue_buckets(spark, sf_dir):
    """Issues after some were resolved, and whether those lie in the buckets that were written again."""
    store = corpus.store_of_days(spark, sf_dir, CUTS[:1])
    late = store.issues().where(F.col("severity_number") == 17).select(
        "fingerprint", F.lit("resolve").alias("action"), F.lit("2024-03-01").cast("timestamp").alias("at")
    )
    corpus.store_actions(store, late, "close", corpus.OBSERVED_AT)
    parts = store.issue_parts()
    version = store.issues_version()
    rewritten = [b for b, v in enumerate(parts) if v == version]
    inside = F.coalesce(bucket_of(F.col("fingerprint"), len(parts)).isin(rewritten), F.lit(False))
    return store.issues().groupBy("status").agg(
        F.count(F.lit(1)).alias("issues"),
        F.sum("event_count").alias("events"),
        F.min(inside | (F.col("status") != schema.RESOLVED)).alias("sound"),
    )


@query
def stream_state(spark, sf_dir):
    """Issues kept as state of a stream that takes the lines in several batches."""
    folder = corpus.new_folder(spark)
    rows = corpus.mixed_lines(spark, sf_dir).select("arrival", "value", "kind")
    # Two batches, of more files where there are more events.
    half = 2 * corpus.tasks_of(corpus.table(spark, sf_dir, "events"))
    rows.repartition(2 * half, F.col("arrival.row")).write.parquet(f"{folder}/queue")

    def lines(kind):
        reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", half)
        return reader.parquet(f"{folder}/queue").where(F.col("kind") == kind).drop("kind")

    kinds = [source.source_type for source in registry.SOURCES]
    drafts = registry.route({kind: lines(kind) for kind in kinds})
    start_issue_state(drafts, f"{folder}/issues", f"{folder}/state").awaitTermination()
    found = issues.opened(read_issues(spark, f"{folder}/issues"))
    return _issue_view(found).drop("resolved_at")


@query
def long_spans(spark, sf_dir):
    """Addresses behind long runs of their signs."""
    found = corpus.log_events(spark, sf_dir).select(F.col("sequence").alias("event_id"), corpus.long_runs().alias("m"))
    spans = F.filter(tokenizer.tokenize(F.col("m")), lambda s: s["type"] == "variable")
    both = once(
        spans,
        lambda found: F.struct(
            F.array_join(F.transform(found, lambda s: s["kind"]), ",").alias("kinds"),
            F.aggregate(found, F.lit(0), lambda n, s: n + F.length(s["value"])).alias("signs"),
        ),
    )
    return found.select("event_id", F.inline(F.array(both)))
