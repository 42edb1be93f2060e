"""Issues as state of a stream."""

import json

from pyspark.sql import functions as F

from logloom.operators import issues, records
from logloom.sources import registry
from logloom.streaming.state import read_issues, start_issue_state

QUEUE = "arrival struct<file:string,block:bigint,row:bigint,event:int>, value string"


def line(message, minute, service, level="error"):
    at = f"2025-09-08T10:{minute:02d}:00Z"
    return json.dumps({"time": at, "msg": message, "service": service, "level": level})


def test_state_of_a_stream_survives_restarts(spark, tmp_path, utc):
    queue, folder, checkpoint = (str(tmp_path / x) for x in ("queue", "issues", "checkpoint"))
    batches = [
        [line("disk 5 full", 9, "b"), line("disk 7 full", 3, None), "broken", line("no route", 1, "a")],
        [line(f"disk {k} full", k % 60, "c" if k % 2 else "a") for k in range(200)],
        [line("late", 5, "z"), line("disk 8 full", 59, "b")],
    ]
    given = []

    def put(k):
        # The second batch arrived before the first one in the order of lines.
        rows = [(("f" if k != 1 else "e", 0, 1000 * k + i, 0), value) for i, value in enumerate(batches[k])]
        given.extend(rows)
        spark.createDataFrame(rows, QUEUE).coalesce(1).write.mode("append").parquet(queue)

    def pump():
        lines = spark.readStream.schema(QUEUE).parquet(queue)
        drafts = registry.parse_as(lines, "json-lines")
        start_issue_state(drafts, folder, checkpoint, parts=3).awaitTermination()

    def shown(frame):
        names = ["fingerprint", "sample_message", "severity_number", "first_seen", "last_seen", "event_count",
                 "affected_services"]
        return sorted(map(str, frame.select(*names).collect()))

    for k in range(3):
        put(k)
        pump()  # each time a new query goes on from the checkpoint
        drafts = registry.parse_as(spark.createDataFrame(given, QUEUE), "json-lines")
        good = records.records(records.assemble(drafts, utc(2026, 1, 1), F.lit("job")))
        assert shown(read_issues(spark, folder)) == shown(issues.fold(records.occurrences(good)))
    pump()
    found = {r["sample_message"]: r for r in read_issues(spark, folder).collect()}
    assert found["disk 0 full"]["event_count"] == 100
    assert found["disk 0 full"]["affected_services"] == ["a"]
    # The last batch wrote the issues it held and no others.
    rows = spark.read.parquet(folder)
    last = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    assert last.select("fingerprint").distinct().count() == 2
