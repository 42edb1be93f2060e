"""Dashboards answered from the counts that imports keep beside the lines."""

import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from logloom import schema
from logloom.functions.times import Window
from logloom.operators import analytics, records, rollups
from logloom.plans import dashboards
from logloom.plans.compaction import compact, vacuum
from logloom.plans.ingest import commit_run
from logloom.plans.store import Store

WINDOWS = [
    ("2025-09-08T10:00:30.500Z", "2025-09-10T03:04:05Z"),
    ("2025-09-08T00:00:00Z", "2025-09-09T00:00:00Z"),
    ("2025-09-08T10:00:10Z", "2025-09-08T10:00:50Z"),
    ("2025-09-08T10:00:30Z", "2025-09-08T10:01:30Z"),
    ("2025-09-09T00:00:00Z", "2025-09-08T00:00:00Z"),
    ("2025-09-08T10:00:00Z", "2025-09-08T10:00:00Z"),
]


def put(spark, store, run, first, utc):
    """A run of 150 records and one rejected line, written without parsing any text."""
    rows = []
    for k in range(151):
        at = utc(2025, 9, 8 + first, 9, 58) + timedelta(seconds=7.3 * k * (1 + first))
        message = f"user {k} {'failed' if k % 3 else 'came'} at {run * (k % 4)}"
        level = [9, 17, 21, None][k % 4]
        host = f"h{k % 5}" if k % 6 else None
        row = (run, k, "no-time" if k == 150 else None, at, message, level, [None, "api", "web"][k % 3], host)
        rows.append(row)
    given = "file string, row bigint, error_code string, timestamp timestamp, body string"
    given += ", severity_number int, service_name string, host string"
    nothing = F.lit(None).cast("string")
    place = F.struct("file", F.lit(0).cast("bigint").alias("block"), "row", F.lit(0).alias("event"))
    drafts = spark.createDataFrame(rows, given).withColumn("arrival", place)
    made = set(schema.RECORD_COLUMNS) - set(drafts.columns) - {"id", "observed_at", "fingerprint", "import_job_id"}
    drafts = drafts.withColumns({name: nothing for name in made})
    store.write_lines(records.assemble(drafts, utc(2025, 10, 1), F.lit("job")), run)
    commit_run(store, run, utc(2025, 10, 1))


def check_all(store, windows=WINDOWS[:1]):
    """Every dashboard query against the one over all records."""
    found, issues = store.records(), store.issues()
    for window in windows:
        pairs = [
            (dashboards.error_rate(store, *window), analytics.error_rate(found, *window)),
            (dashboards.by_service(store, *window), analytics.by_service(found, *window)),
            (dashboards.top_issues(store, *window), analytics.top_issues(found, issues, *window)),
            (dashboards.spikes(store, *window), analytics.spikes(found, issues, *window)),
        ]
        for got, wanted in pairs:
            assert got.columns == wanted.columns and got.collect() == wanted.collect(), window
        got, wanted = dashboards.blast_radius(store, *window), analytics.blast_radius(found, *window)
        assert sorted(got.collect()) == sorted(wanted.collect()), window


def without_rollups(spark, store):
    """Make a store look as if it had been written before there were rollups."""
    path = f"{store.base}/runs"
    rows = spark.createDataFrame(store.runs().drop("rolled").collect(), store.runs().drop("rolled").schema)
    rows.write.mode("overwrite").parquet(path)
    for kind in rollups.ROLLUPS:
        store.delete(f"{store.base}/{kind}")


def test_equal_to_the_direct_queries(spark, tmp_path, utc):
    store = Store(spark, str(tmp_path / "store"))
    put(spark, store, "a", 0, utc)
    put(spark, store, "b", 1, utc)
    check_all(store, WINDOWS[3:4])
    assert store.rollup(rollups.MINUTES).agg(F.sum("total")).first()[0] == store.records().count()
    compact(store)
    put(spark, store, "c", 2, utc)
    compact(store)
    vacuum(store)
    assert not any((tmp_path / "store" / kind / "run=a").exists() for kind in rollups.ROLLUPS)
    assert store.rollup(rollups.DAYS).agg(F.sum("total")).first()[0] == store.records().count()
    check_all(store)


def test_older_stores_are_counted_directly_until_they_are_merged(spark, tmp_path, utc):
    store = Store(spark, str(tmp_path / "store"))
    put(spark, store, "a", 0, utc)
    without_rollups(spark, store)
    assert store.rollup(rollups.MINUTES).isEmpty() and store.uncounted().count() == 150
    put(spark, store, "b", 1, utc)
    assert store.uncounted().count() == 150
    check_all(store)
    compact(store)
    assert store.uncounted() is None
    assert store.rollup(rollups.MINUTES).agg(F.sum("total")).first()[0] == store.records().count() == 300
    check_all(store)


def test_records_are_read_at_the_edges_only(spark, tmp_path, utc):
    store = Store(spark, str(tmp_path / "store"))
    put(spark, store, "a", 0, utc)

    def tables(frame):
        return {name for name in ("lines", "minutes", "days") if any(f"/{name}/" in f for f in frame.inputFiles())}

    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    whole = dashboards.error_rate(store, "2025-09-08T10:00:00Z", "2025-09-10T03:04:00Z")
    assert tables(whole) == {"minutes"}
    assert tables(dashboards.blast_radius(store, "2025-09-08T00:00:00Z", "2025-09-10T00:00:00Z")) == {"days"}
    assert tables(dashboards.blast_radius(store, *WINDOWS[0])) == {"days", "lines"}
    assert "body" not in plan(dashboards.blast_radius(store, *WINDOWS[0]))
    # Minutes and edges are sought in the days that hold them.
    ragged = plan(dashboards.counts(store, Window.of(*WINDOWS[0])))
    assert len(re.findall(r"PartitionFilters: \[[^\]]*event_date", ragged)) == 3


def test_an_empty_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "none"))
    for window in (WINDOWS[0], WINDOWS[4], WINDOWS[5]):
        assert dashboards.by_service(store, *window).isEmpty()
        assert dashboards.blast_radius(store, *window).isEmpty()
        assert not dashboards.error_rate(store, *window).agg(F.sum("total")).first()[0]
    with pytest.raises(ValueError):
        dashboards.top_issues(store, *WINDOWS[0], limit=0)


@pytest.mark.parametrize("kind, step", [(rollups.MINUTES, 60), (rollups.DAYS, 86400)])
def test_cuts(kind, step, utc):
    base = utc(2025, 9, 8)
    for start in (0, 1, 59.999, 60, 86399, 86400):
        for length in (-5, 0, 0.001, 30, 60, 90, 86400, 200_000):
            window = Window(base + timedelta(seconds=start), base + timedelta(seconds=start + length))
            inner, edges = dashboards.cut(window, kind)
            pieces = sorted([*edges, *([inner] if inner else [])], key=lambda w: w.start)
            if length <= 0:
                assert not pieces
                continue
            assert pieces[0].start == window.start and pieces[-1].end == window.end
            assert all(a.end == b.start for a, b in zip(pieces, pieces[1:]))
            assert all(edge.length < timedelta(seconds=2 * step) for edge in edges)
            if inner:
                assert all((m - base).total_seconds() % step == 0 for m in (inner.start, inner.end))
