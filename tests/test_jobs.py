"""Import jobs end to end: batch, stream, failure, re-run, reading back."""

import json

import pytest
from pyspark.sql import functions as F

from checks import corpus
from logloom.operators import analytics, integrity, listing
from logloom.plans.actions import store_actions
from logloom.plans.ingest import EmptyInput, choose_formats, ingest, reprocess, reprocess_into
from logloom.plans.store import Store
from logloom.sources import lines as line_ops
from logloom.streaming import ingest as streaming

ENVELOPE = {
    "logGroup": "/aws/lambda/pay", "logStream": "s",
    "logEvents": [
        {"id": "1", "timestamp": 1757325600000, "message": "order 1 failed"},
        {"id": "2", "timestamp": 1757325600500, "message": "order 22 failed"},
    ],
}
FILES = {
    "a.jsonl": ['{"time":"2025-09-08T10:00:00Z","msg":"disk 5 full","service":"api","level":"error"}',
                "", "broken", '{"time":"2025-09-08T09:00:00Z","msg":"disk 7 full","service":"api","level":"error"}'],
    "b.json": [json.dumps(ENVELOPE), json.dumps(dict(ENVELOPE, logEvents=[]))],
    "c d.json": [json.dumps({"logName": "l", "timestamp": "2025-09-09T10:00:00Z", "severity": "INFO",
                             "textPayload": f"hello {i}"}) for i in range(30)],
}


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    for name, lines in FILES.items():
        (folder / name).write_text("\n".join(lines) + "\n")
    return folder


def test_import_of_a_folder(spark, landing, tmp_path):
    base = str(tmp_path / "store")
    outcome = ingest(spark, str(landing), base, run="one")
    assert (outcome.processed_lines, outcome.parse_errors, outcome.ingested_records) == (36, 2, 34)
    store = Store(spark, base)
    kinds = {r[0]: r[1] for r in store.records().groupBy("source_type").count().collect()}
    assert kinds == {"json-lines": 2, "aws-cloudwatch": 2, "gcp-cloud-logging": 30}
    assert sorted(r["error_code"] for r in store.rejects().collect()) == ["empty-line", "malformed-syntax"]

    issues = {r["sample_message"]: r for r in store.issues().collect()}
    assert {m: r["event_count"] for m, r in issues.items()} == {
        "disk 5 full": 2, "order 1 failed": 2, "hello 0": 30,
    }
    disk = store.issues().where("sample_message = 'disk 5 full'")
    seen = disk.select(F.date_format("first_seen", "HH"), F.date_format("last_seen", "HH")).first()
    assert tuple(seen) == ("10", "10")
    assert disk.first()["affected_services"] == ["api"]

    jobs = {r["filename"]: r for r in store.jobs().collect()}
    assert {name: (r["status"], r["total_lines"], r["parse_errors"]) for name, r in jobs.items()} == {
        "a.jsonl": ("COMPLETED", 4, 2), "b.json": ("COMPLETED", 2, 0), "c d.json": ("COMPLETED", 30, 0),
    }
    assert integrity.records_without_issue(store.records(), store.issues()).count() == 0
    assert integrity.records_without_job(store.records(), store.jobs()).count() == 0

    # The same run again does nothing; a new run counts the lines again.
    ingest(spark, str(landing), base, run="one")
    assert store.records().count() == 34
    ingest(spark, str(landing), base, run="two")
    assert store.records().count() == 68
    assert store.issues().where("sample_message = 'hello 0'").first()["event_count"] == 60

    assert store.newest().isoformat() == "2025-09-09T10:00:00+00:00"
    page = listing.list_logs(store.records(), service="api", limit=1, newest=store.newest())
    assert page.records[0]["body"] == "disk 5 full" and page.next_cursor
    rates = analytics.error_rate(store.records(), "2025-09-08T00:00:00Z", "2025-09-10T00:00:00Z")
    assert rates.agg(F.sum("total"), F.sum("errors")).first() == (68, 4)

    again = reprocess(store)
    assert again.where("error_code is null").count() == 68
    assert again.where("error_code is not null").count() == 4


def test_time_filter_reaches_the_files(spark, landing, tmp_path):
    base = str(tmp_path / "store")
    ingest(spark, str(landing), base, run="one")
    rates = analytics.by_service(
        Store(spark, base).records(), "2025-09-08T00:00:00Z", "2025-09-09T00:00:00Z"
    )
    plan = rates._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "severity_number" in line)
    assert "GreaterThanOrEqual(timestamp" in scan and "event_date" in scan.split("PartitionFilters")[1]
    columns = scan.split("ReadSchema: ")[1]
    assert "body" not in columns and "raw" not in columns


def test_forced_type_and_bad_input(spark, landing, tmp_path):
    base = str(tmp_path / "store")
    with pytest.raises(ValueError, match="accepted"):
        ingest(spark, str(landing), base, source_type="nginx")
    with pytest.raises(Exception):
        ingest(spark, str(landing / "missing"), base)
    (tmp_path / "empty").write_text("")
    with pytest.raises(EmptyInput):
        ingest(spark, str(tmp_path / "empty"), base)
    outcome = ingest(spark, str(landing / "b.json"), base, source_type="json-lines")
    assert (outcome.processed_lines, outcome.parse_errors) == (2, 0)
    record = Store(spark, base).records().orderBy("arrival").first()
    assert record["source_type"] == "json-lines" and record["body"] == "order 1 failed"


def test_a_failed_run_stays_invisible(spark, landing, tmp_path, monkeypatch):
    base = str(tmp_path / "store")

    def fail(*args, **kwargs):
        raise RuntimeError("disk full")

    monkeypatch.setattr(Store, "write_issues", fail)
    with pytest.raises(RuntimeError):
        ingest(spark, str(landing), base, run="bad")
    monkeypatch.undo()
    store = Store(spark, base)
    assert store.records().count() == 0 and store.issues().count() == 0
    assert {(r["status"], r["error"]) for r in store.jobs().collect()} == {("FAILED", "disk full")}
    ingest(spark, str(landing), base, run="bad")
    assert store.records().count() == 34


NAMES = ["app[1].log", "app1.log", "a {x,y} 50%*?+.log", "back\\slash.log", "%5B.log"]


def test_file_names_are_no_patterns(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    for k, name in enumerate(NAMES):
        lines = [json.dumps({"time": "2030-01-01T00:00:00Z", "msg": f"{name} {i}"}) for i in range(k + 1)]
        (folder / name).write_text("\n".join(lines) + "\n")
    # A second format, so that files have to be read by name.
    (folder / "g].json").write_text(json.dumps({"logName": "l", "timestamp": "2030-01-01T00:00:00Z", "textPayload": "g"}))
    base = str(tmp_path / "store")
    assert ingest(spark, f"{folder}/*", base, run="one").ingested_records == 16
    store = Store(spark, base)
    bodies = sorted(r["body"] for r in store.records().collect())
    assert bodies == sorted([f"{name} {i}" for k, name in enumerate(NAMES) for i in range(k + 1)] + ["g"])
    jobs = {r["filename"]: (r["status"], r["total_lines"], r["processed_lines"]) for r in store.jobs().collect()}
    assert jobs == {**{n: ("COMPLETED", k + 1, k + 1) for k, n in enumerate(NAMES)}, "g].json": ("COMPLETED", 1, 1)}
    query = streaming.start_import(spark, str(folder), f"{base}2", str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert Store(spark, f"{base}2").records().count() == 16


def test_a_run_that_ended_after_its_publication_is_closed(spark, landing, tmp_path, monkeypatch):
    base = str(tmp_path / "store")

    def die(*args, **kwargs):
        raise KeyboardInterrupt

    monkeypatch.setattr("logloom.plans.ingest.close_jobs", die)
    with pytest.raises(KeyboardInterrupt):
        ingest(spark, str(landing), base, run="one")
    monkeypatch.undo()
    store = Store(spark, base)
    jobs = store.jobs().collect()
    assert {r["status"] for r in jobs} == {"RUNNING"}
    # What is known so far: lines that are written, with their errors.
    assert sorted((r["processed_lines"], r["parse_errors"]) for r in jobs) == [(2, 0), (4, 2), (30, 0)]
    ingest(spark, str(landing), base, run="one")
    assert store.records().count() == 34
    jobs = store.jobs().collect()
    assert {r["status"] for r in jobs} == {"COMPLETED"}
    assert sorted((r["processed_lines"], r["parse_errors"]) for r in jobs) == [(2, 0), (4, 2), (30, 0)]
    assert all(r["finished_at"] >= r["created_at"] for r in jobs)
    count = store.transitions().count()
    ingest(spark, str(landing), base, run="one")
    assert store.transitions().count() == count


def test_envelope_events_are_exploded_alone(spark, lines):
    plan = line_ops.expand_envelopes(lines("x"))._jdf.queryExecution().optimizedPlan().toString()
    (generate,) = [line for line in plan.splitlines() if "Generate posexplode" in line]
    assert "value" not in generate.split("posexplode(")[0] and "_events" not in generate


def test_state_changes_and_lines_are_written_back(spark, landing, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest(spark, str(landing), store.base, run="one")
    at = F.lit("2026-01-01").cast("timestamp")
    resolve = store.issues().select("fingerprint", F.lit("resolve").alias("action"), at.alias("at"))
    assert store_actions(store, resolve, "close").count() == 0
    assert {r["status"] for r in store.issues().collect()} == {"resolved"}
    reopen = resolve.withColumn("action", F.lit("reopen"))
    assert store_actions(store, reopen, "wrong").count() == 3
    assert store_actions(store, resolve, "close").count() == 0
    again = reprocess_into(store, f"{store.base}-again")
    ingest(spark, str(landing / "a.jsonl"), store.base, run="two")
    found = {r["sample_message"]: (r["status"], r["regression"]) for r in store.issues().collect()}
    assert found == {
        "disk 5 full": ("unresolved", True), "order 1 failed": ("resolved", False), "hello 0": ("resolved", False),
    }
    assert again.records().count() == 34 and again.rejects().count() == 2
    assert {r["event_count"] for r in again.issues().collect()} == {2, 30}
    assert reprocess_into(store, again.base).records().count() == 36


def test_heads_of_files(spark, landing, tmp_path):
    long = landing / "long.json"
    filler = ['{"logGroup":"g","logStream":"s","logEvents":[]}', "  "] * 30
    long.write_text("\n".join(filler + [f"line {i}" for i in range(2000)]))
    heads = line_ops.read_heads(spark, [str(long)])
    values = [r["value"] for r in heads.orderBy("arrival").collect()]
    assert values == filler + [f"line {i}" for i in range(20)]
    found = {path.rsplit("/", 1)[1]: kind for kind, paths in choose_formats(spark, str(landing)).items() for path in paths}
    assert found == {
        "a.jsonl": "json-lines", "b.json": "aws-cloudwatch", "c d.json": "gcp-cloud-logging",
        "long.json": "json-lines",
    }


def test_line_ends_and_metering(spark, tmp_path):
    path = tmp_path / "x.log"
    path.write_bytes(b"a\r\nb\rc\n\nd")
    scanned = line_ops.scan_lines(spark, str(path))
    assert [r["value"] for r in scanned.orderBy("arrival").collect()] == ["a", "b", "c", "", "d"]
    sizes = line_ops.meter(scanned, spark, str(path)).first()
    assert (sizes["size_bytes"], sizes["total_lines"]) == (9, 5)


def test_stream_equals_batch(spark, landing, tmp_path):
    base, batch = str(tmp_path / "stream"), str(tmp_path / "batch")
    ingest(spark, str(landing), batch, run="one")

    def pump():
        query = streaming.start_import(
            spark, str(landing), base, str(tmp_path / "progress"), max_files_per_batch=1
        )
        query.awaitTermination()

    pump()
    stream, whole = Store(spark, base), Store(spark, batch)
    columns = ["fingerprint", "sample_message", "event_count", "first_seen", "last_seen", "affected_services"]

    def state(store):
        return sorted(map(str, store.issues().select(*columns).collect()))

    assert state(stream) == state(whole)
    assert stream.runs().count() == 3 and stream.jobs().count() == 3
    body = ["timestamp", "body", "severity_number", "service_name", "source_type", "attributes"]
    assert sorted(map(str, stream.records().select(*body).collect())) == sorted(
        map(str, whole.records().select(*body).collect())
    )
    # Nothing new has arrived, so nothing changes.
    pump()
    assert stream.runs().count() == 3


def test_a_stream_of_lines(spark, tmp_path):
    rows = [(line, name, 0) for name, lines in FILES.items() for line in lines]
    schema = "value string, file string, block bigint"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "queue"))
    base = str(tmp_path / "store")
    for _ in range(2):
        lines = spark.readStream.schema(schema).parquet(str(tmp_path / "queue"))
        streaming.start_lines(lines, base, str(tmp_path / "progress")).awaitTermination()
    assert Store(spark, base).records().count() == 34 and Store(spark, base).runs().count() == 1


def test_batches_of_a_stream_without_files(spark, tmp_path):
    base = str(tmp_path / "store")
    rows = [(line, name, 0) for name, lines in FILES.items() for line in lines]
    lines = spark.createDataFrame(rows, "value string, file string, block bigint").coalesce(1)
    for _ in range(2):  # A batch that is delivered once more is dropped.
        streaming.import_batch(lines, 7, base)
    store = Store(spark, base)
    assert store.runs().count() == 1 and store.records().count() == 34
    assert store.rejects().count() == 2 and store.issues().count() == 3
    assert {r["status"] for r in store.jobs().collect()} == {"COMPLETED"}


def _events_in_one_row_group(spark, folder, rows):
    events = spark.range(rows - 1, -1, -1, 1).select(
        F.when(F.col("id") != 7, F.col("id")).alias("event_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 100).alias("user_id"),
        F.lit("error").alias("event_type"),
        F.lit(1.5).alias("value"),
        F.lit('{"k": 3}').alias("props"),
    )
    events.coalesce(1).write.parquet(f"{folder}/events.parquet")


def test_rows_of_one_row_group_are_worked_on_by_several_tasks(spark, tmp_path):
    _events_in_one_row_group(spark, tmp_path, 3 * corpus.LEAST_ROWS)
    found = corpus.log_events(spark, str(tmp_path)).select("sequence", F.spark_partition_id().alias("task"))
    tasks = found.groupBy("task").agg(F.count("*").alias("n"), F.min("sequence").alias("a"), F.max("sequence").alias("b"))
    tasks = tasks.orderBy("task").collect()
    assert len(tasks) == 3 and max(t["n"] for t in tasks) < 2 * corpus.LEAST_ROWS
    assert sum(t["n"] for t in tasks) == 3 * corpus.LEAST_ROWS
    assert all(first["b"] < second["a"] for first, second in zip(tasks, tasks[1:]))


def test_a_task_holds_a_bounded_number_of_rows():
    assert [corpus.tasks_for(n, 12) for n in (0, 1, 10_000, 10_001, 100_000, 6_000_000, 36_000_000)] == [
        1, 1, 1, 2, 10, 24, 144,
    ]
