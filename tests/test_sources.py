"""Parsers, envelopes, samples and format choice on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from logloom.functions.times import iso_text
from logloom.operators import records
from logloom.sources import lines as line_ops
from logloom.sources import registry, render


def parse(lines, kind, *values):
    drafts = registry.parse_as(lines(*values), kind)
    rows = drafts.withColumn("timestamp", iso_text(F.col("timestamp"))).orderBy("arrival").collect()
    return [row.asDict() for row in rows]


STAMP = '"timestamp":"2026-09-08T10:00:00Z"'


def test_json_lines_of_several_writers(lines):
    rows = parse(
        lines,
        "json-lines",
        '{"ts":1893456000,"body":"lift stuck","name":"tower","floor":7}',
        "<not an object>",
        '{"@timestamp":"2030-01-01 00:00:07","msg":"belt slow","service":"mill","level":"WARNING","speed":{"now":1}}',
        '{"msg":"no time given","level":"error"}',
        '{"time":1893456009250,"message":"doors open","severity":"fatal","tags":["a",2]}',
    )
    assert [r["error_code"] for r in rows] == [None, "malformed-syntax", None, "missing-timestamp", None]
    assert [r["timestamp"] for r in rows if not r["error_code"]] == [
        "2030-01-01T00:00:00.000Z", "2030-01-01T00:00:07.000Z", "2030-01-01T00:00:09.250Z",
    ]
    assert [(r["severity_number"], r["severity_text"]) for r in rows if not r["error_code"]] == [
        (None, None), (13, "WARNING"), (21, "fatal"),
    ]
    assert [r["body"] for r in rows if not r["error_code"]] == ["lift stuck", "belt slow", "doors open"]
    assert rows[2]["service_name"] == "mill"
    assert json.loads(rows[2]["attributes"]) == {"speed": {"now": 1}}
    assert json.loads(rows[4]["attributes"]) == {"tags": ["a", 2]}
    assert rows[1]["raw"] == "<not an object>"


@pytest.mark.parametrize(
    "line, expected",
    [
        (f'{{"message":null,"msg":"   ","body":"real",{STAMP}}}', {"body": "real"}),
        (f'{{"message":"","msg":42,{STAMP}}}', {"body": "", "attributes": '{"message":"","msg":42}'}),
        ('{"body":"x","timestamp":-5}', {"error_code": "missing-timestamp"}),
        ('{"timestamp":"not a date","time":"also not"}', {"error_code": "missing-timestamp"}),
        ('{"body":"x","timestamp":0}', {"timestamp": "1970-01-01T00:00:00.000Z"}),
        ('{"body":"x","timestamp":"bad","ts":1757325602}', {"attributes": '{"timestamp":"bad"}'}),
        (f'{{"level":null,"severity":"error",{STAMP}}}', {"severity_number": None, "severity_text": None}),
        (f'{{"level":30,{STAMP}}}', {"severity_text": "30", "attributes": "{}"}),
        (f'{{"level":{{"a":1}},{STAMP}}}', {"attributes": '{"level":{"a":1}}'}),
        (f'{{"service":"  s  ",{STAMP}}}', {"service_name": "  s  "}),
        (
            f'{{"serviceName":"x","host":5,"environment":"e","env":"p","region":"r",{STAMP}}}',
            {"host": None, "environment": "p", "attributes": '{"region":"r"}'},
        ),
        (f'{{"level":"error","level":"info",{STAMP}}}', {"severity_number": 9}),
        ("[1,2]", {"error_code": "unrecognized-shape"}),
        ("null", {"error_code": "unrecognized-shape"}),
        ("   \t ", {"error_code": "empty-line"}),
        (" ", {"error_code": "empty-line"}),
        ('{"a":1} tail', {"error_code": "malformed-syntax"}),
        (f'{{"a":{"[" * 200}{"]" * 200},{STAMP}}}', {"error_code": None}),
    ],
)
def test_json_lines_rules(lines, line, expected):
    (row,) = parse(lines, "json-lines", line)
    assert {key: row[key] for key in expected} == expected


def gcp(**members):
    entry = {"logName": "l", "timestamp": "2026-09-08T10:15:30.123456789Z", "textPayload": "t"}
    entry.update(members)
    return json.dumps({k: v for k, v in entry.items() if v is not ...})


@pytest.mark.parametrize(
    "line, expected",
    [
        (gcp(), {"timestamp": "2026-09-08T10:15:30.123Z", "body": "t", "attributes": "{}"}),
        (gcp(textPayload="", jsonPayload={"message": "j"}), {"body": ""}),
        (gcp(textPayload=..., jsonPayload={"message": "j", "n": 1}), {"body": "j", "attributes": '{"n":1}'}),
        (
            gcp(textPayload=..., jsonPayload={"z": 1.0, "a": {"y": 2, "b": "1.0"}}),
            {"body": '{"z":1,"a":{"y":2,"b":"1.0"}}'},
        ),
        (gcp(textPayload=...), {"body": ""}),
        (gcp(resource={"type": "k8s_container", "labels": {"container_name": "api", "pod": "p"}}),
         {"service_name": "api", "attributes": '{"labels":{"pod":"p"}}'}),
        (gcp(resource={"type": "pubsub_topic", "labels": {"topic_id": "x"}}),
         {"service_name": None, "attributes": '{"labels":{"topic_id":"x"}}'}),
        (gcp(resource={"type": "gae_app", "labels": {"module_id": "m", "a": "1"}}, labels={"a": "2"}),
         {"service_name": "m", "attributes": '{"labels":{"a":"2"}}'}),
        (gcp(trace="projects/p/traces/abc", spanId="s"), {"trace_id": "abc", "span_id": "s"}),
        (gcp(trace="abc"), {"trace_id": "abc"}),
        (gcp(severity="DEFAULT"), {"severity_number": None, "severity_text": "DEFAULT"}),
        (gcp(severity="EMERGENCY"), {"severity_number": 21}),
        (gcp(severity=None), {"error_code": "unrecognized-shape"}),
        (gcp(labels={"a": 1}), {"error_code": "unrecognized-shape"}),
        (gcp(resource={"labels": []}), {"error_code": "unrecognized-shape"}),
        (gcp(resource={"type": 1}), {"error_code": "unrecognized-shape"}),
        (gcp(httpRequest=[]), {"error_code": "unrecognized-shape"}),
        (gcp(timestamp=...), {"error_code": "missing-timestamp"}),
        (gcp(timestamp=""), {"error_code": "missing-timestamp"}),
        (gcp(timestamp="not-a-date"), {"error_code": "missing-timestamp"}),
        (gcp(timestamp=5), {"error_code": "unrecognized-shape"}),
        (
            gcp(jsonPayload={"labels": "own", "insertId": "low", "host": "h"}, insertId="i",
                httpRequest={"status": 500}, operation={"id": "o"}),
            {"attributes": '{"insertId":"i","labels":"own","httpRequest":{"status":500},"operation":{"id":"o"}}'},
        ),
        ("[]", {"error_code": "unrecognized-shape"}),
        ("{ broken", {"error_code": "malformed-syntax"}),
    ],
)
def test_gcp_rules(lines, line, expected):
    (row,) = parse(lines, "gcp-cloud-logging", line)
    assert {key: row[key] for key in expected} == expected


def cloudwatch(**members):
    event = {
        "logGroup": "/aws/lambda/checkout-api", "logStream": "s", "id": "1",
        "timestamp": 1757325600000, "message": "m",
    }
    event.update(members)
    return json.dumps({k: v for k, v in event.items() if v is not ...})


@pytest.mark.parametrize(
    "line, expected",
    [
        (cloudwatch(), {"body": "m", "service_name": "checkout-api", "timestamp": "2025-09-08T10:00:00.000Z",
                        "attributes": '{"id":"1","logGroup":"/aws/lambda/checkout-api","logStream":"s"}'}),
        (cloudwatch(message='{"z":1,"a":2,"m":3}'), {"body": '{"a":2,"m":3,"z":1}', "severity_text": None}),
        (cloudwatch(message='{"level":"  ErRoR  "}'), {"severity_number": 17, "severity_text": "  ErRoR  "}),
        (cloudwatch(message='{"level":30}'), {"severity_number": None, "severity_text": "30"}),
        (cloudwatch(message='{"level":null,"severity":"WARNING"}'), {"severity_number": 13}),
        (cloudwatch(message="database ERROR: timeout"), {"severity_number": None}),
        (cloudwatch(message='{"a":1} tail'), {"body": '{"a":1} tail'}),
        (cloudwatch(message=""), {"body": ""}),
        (cloudwatch(message=...), {"body": ""}),
        (cloudwatch(message={"a": 1}), {"body": ""}),
        (cloudwatch(logGroup="custom"), {"service_name": None}),
        (cloudwatch(logGroup="/aws/ecs/a/b"), {"service_name": "a/b"}),
        (cloudwatch(logGroup=..., id=None), {"attributes": '{"logStream":"s"}'}),
        (cloudwatch(timestamp=...), {"error_code": "missing-timestamp"}),
        (cloudwatch(timestamp=None), {"error_code": "invalid-timestamp"}),
        (cloudwatch(timestamp="1757325600000"), {"error_code": "invalid-timestamp"}),
        (cloudwatch(timestamp=1757325600.5), {"error_code": "invalid-timestamp"}),
        (cloudwatch(timestamp=0), {"error_code": "invalid-timestamp"}),
        (cloudwatch(timestamp=-5), {"error_code": "invalid-timestamp"}),
        ("42", {"error_code": "unrecognized-shape"}),
        ('{"logGroup":"x"', {"error_code": "malformed-syntax"}),
    ],
)
def test_cloudwatch_rules(lines, line, expected):
    (row,) = parse(lines, "aws-cloudwatch", line)
    assert {key: row[key] for key in expected} == expected


def test_envelopes(lines):
    envelope = {
        "owner": "1", "logGroup": "g", "logStream": "s",
        "logEvents": [{"id": "1", "timestamp": 5}, "text", None, {"logStream": "own"}],
    }
    empty = dict(envelope, logEvents=[])
    partial = {"logGroup": "g", "logEvents": [1]}
    values = ["plain", json.dumps(envelope), json.dumps(empty), json.dumps(partial), ""]
    rows = line_ops.expand_envelopes(lines(*values)).orderBy("arrival").collect()
    assert [(r["arrival"]["row"], r["arrival"]["event"]) for r in rows] == [
        (0, 0), (1, 0), (1, 1), (1, 2), (1, 3), (3, 0), (4, 0),
    ]
    assert rows[0]["value"] == "plain" and rows[5]["value"] == values[3] and rows[6]["value"] == ""
    base = {"logGroup": "g", "logStream": "s"}
    assert [json.loads(r["value"]) for r in rows[1:5]] == [
        dict(base, id="1", timestamp=5), dict(base, message="text"), dict(base, message=None),
        {"logGroup": "g", "logStream": "own"},
    ]


def scores_of(lines, *values):
    rows = registry.detect(lines(*values)).collect()
    return rows[0] if rows else None


def test_detection(lines):
    assert scores_of(lines, gcp(), gcp(labels={"a": 1}))["gcp-cloud-logging"] == 0.5
    assert scores_of(lines, gcp())["source_type"] == "gcp-cloud-logging"
    assert scores_of(lines, cloudwatch(), "x")["source_type"] == "aws-cloudwatch"
    assert scores_of(lines, '{"a":1}', "x", "y")["source_type"] == "json-lines"
    assert scores_of(lines, '{"a":1}', "x")["json-lines"] == 0.0
    assert scores_of(lines, '{"a":1}', '{"b":1}', "x")["json-lines"] == 0.3
    # A weak lead does not beat the fallback.
    assert scores_of(lines, gcp(), *['{"a":1}'] * 3)["source_type"] == "json-lines"
    assert scores_of(lines, gcp(), cloudwatch())["source_type"] == "gcp-cloud-logging"
    assert scores_of(lines, "", "  ") is None
    # Only the first 20 non-blank lines count.
    assert scores_of(lines, *[""] * 5, *[gcp()] * 20, *["x"] * 60)["gcp-cloud-logging"] == 1.0


def test_forced_type_is_checked():
    assert registry.check_source_type(None) is None
    with pytest.raises(ValueError, match="json-lines"):
        registry.check_source_type("nginx")


def test_a_source_can_be_added(lines):
    class Plain:
        source_type = "plain"

        def score(self):
            return F.lit(0.9)

        def parse(self, frame):
            from logloom.sources import base

            kept = frame.select("arrival", "value", F.lit(None).cast("string").alias("error_code"))
            return base.draft(
                kept, "plain", timestamp=F.timestamp_millis(F.lit(0)), body=F.col("value")
            )

    sources = (*registry.SOURCES, Plain())
    assert registry.detect(lines("a"), sources).first()["source_type"] == "plain"
    assert registry.parse_as(lines("a"), "plain", sources).first()["body"] == "a"


@pytest.mark.parametrize("kind", registry.source_types())
def test_rendered_lines_parse_back(spark, lines, kind, utc):
    events = spark.createDataFrame(
        [
            (0, utc(2026, 9, 8, 10), "checkout", "error", "it broke 5 times", "t1", "h1"),
            (1, utc(2026, 9, 8, 11), "billing", "warn", 'say "hi"', "t2", None),
            (2, utc(2026, 9, 8, 12), None, None, "", None, None),
        ],
        "sequence bigint, timestamp timestamp, service_name string, severity string, body string,"
        "trace_id string, host string",
    )
    values = [row["value"] for row in render.render(events, kind).collect()]
    rows = parse(lines, kind, *values)
    assert [r["error_code"] for r in rows] == [None] * 3
    assert [r["service_name"] for r in rows] == ["checkout", "billing", None]
    assert scores_of(lines, *values)["source_type"] == kind
    if kind != "aws-cloudwatch":
        assert [r["body"] for r in rows] == ["it broke 5 times", 'say "hi"', ""]
        assert [r["severity_number"] for r in rows] == [17, 13, None]
        assert [r["trace_id"] for r in rows] == ["t1", "t2", None]
    with pytest.raises(ValueError):
        render.render(events, "nginx")


def test_error_counts_and_totals(lines, utc):
    drafts = registry.parse_as(lines("", "x", "[1]", "{}", f"{{{STAMP}}}"), "json-lines")
    whole = records.assemble(drafts, utc(2026, 1, 1), F.lit("job"))
    counts = {row["error_code"]: row["lines"] for row in records.error_counts(whole).collect()}
    assert counts == {
        "empty-line": 1, "malformed-syntax": 1, "unrecognized-shape": 1, "missing-timestamp": 1,
    }
    assert tuple(records.run_totals(whole).first()) == (5, 4, 1)
    good = records.records(whole).first()
    again = records.records(whole).first()
    assert good["id"] == again["id"] and len(good["id"]) == 36
    assert len(good["fingerprint"]) == 40
    assert records.rejects(whole).count() == 4
