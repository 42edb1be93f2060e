"""The store: buckets of issues, files that fail alone, live counts, compaction."""

import gzip
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logloom.operators import ledger
from logloom.plans.actions import store_actions
from logloom.plans.compaction import compact, vacuum
from logloom.plans.ingest import ingest, unreadable
from logloom.plans.progress import Watch
from logloom.plans.store import Store, bucket_of


def entry(message, at="2025-09-08T10:00:00Z", service="api"):
    return json.dumps({"time": at, "msg": message, "service": service, "level": "error"})


#: Messages of different structure, so that each is an issue of its own.
KINDS = ["disk full", "no route", "bad gateway", "late reply", "cache miss", "lost lock", "torn page", "cold start",
         "split brain", "slow query"]


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    for k, message in enumerate(KINDS):
        (folder / f"{k}.jsonl").write_text("\n".join([entry(message)] * (k + 1)) + "\n")
    return folder


def written_buckets(base, version):
    """Files of issues by bucket that a version has written."""
    found = {}
    for path in (base / "store" / "issues" / f"version={version}").glob("bucket=*/*.parquet"):
        found[int(path.parent.name.removeprefix("bucket="))] = found.get(int(path.parent.name.removeprefix("bucket=")), 0) + 1
    return found


def counts(store):
    return {r["sample_message"]: r["event_count"] for r in store.issues().collect()}


def test_a_commit_rewrites_only_the_buckets_it_touches(spark, landing, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest(spark, str(landing), store.base, run="one")
    parts = store.issue_parts()
    assert len(parts) == store.issue_buckets and set(parts) == {0, 1}
    assert written_buckets(tmp_path, 1).keys() == {b for b, v in enumerate(parts) if v}

    ingest(spark, str(landing / "3.jsonl"), store.base, run="two")
    hit = store.issues().where("sample_message = 'late reply'").select(bucket_of(F.col("fingerprint"), 32)).first()[0]
    assert written_buckets(tmp_path, 2) == {hit: 1}
    assert store.issue_parts() == [2 if b == hit else v for b, v in enumerate(parts)]
    assert counts(store) == {m: (k + 1) * (2 if k == 3 else 1) for k, m in enumerate(KINDS)}
    # The older snapshot can still be read.
    assert {r["event_count"] for r in store.issues(1).where("sample_message = 'late reply'").collect()} == {4}

    key = store.issues().where("sample_message = 'disk full'").first()["fingerprint"]
    at = F.lit("2026-01-01").cast("timestamp")
    actions = spark.createDataFrame([(key, "resolve"), ("unknown", "ignore")], "fingerprint string, action string")
    refused = store_actions(store, actions.withColumn("at", at), "close")
    assert [r["fingerprint"] for r in refused.collect()] == ["unknown"]
    asked = set(store.touched(actions, 32))
    assert written_buckets(tmp_path, 3).keys() <= asked and len(asked) <= 2
    assert store.issues_near(key).where(F.col("fingerprint") == key).first()["status"] == "resolved"
    ingest(spark, str(landing / "0.jsonl"), store.base, run="three")
    back = store.issues().where(F.col("fingerprint") == key).first()
    assert (back["status"], back["regression"], back["event_count"]) == ("unresolved", True, 2)
    assert len(counts(store)) == len(KINDS)


def test_the_number_of_buckets_is_that_of_the_store(spark, landing, tmp_path):
    base = str(tmp_path / "store")
    ingest(spark, str(landing), base, run="zero")
    few = Store(spark, f"{base}-few", issue_buckets=3)
    assert few.issue_parts() == [0, 0, 0] and few.issues().count() == 0
    assert len(Store(spark, base, issue_buckets=7).issue_parts()) == 32
    with pytest.raises(ValueError):
        Store(spark, base, issue_buckets=0)


def test_an_unreadable_file_fails_alone(spark, landing, tmp_path):
    whole = gzip.compress(("\n".join([entry("packed")] * 500) + "\n").encode())
    (landing / "good.json.gz").write_bytes(whole)
    (landing / "torn.json.gz").write_bytes(whole[: len(whole) // 2])
    (landing / "junk.json.gz").write_bytes(b"\x1f\x8b\x08 this is no archive")
    base = str(tmp_path / "store")
    outcome = ingest(spark, str(landing), base, run="one")
    assert (outcome.processed_lines, outcome.failed_files) == (55 + 500, 2)
    store = Store(spark, base)
    jobs = {r["filename"]: r for r in store.jobs().collect()}
    assert {n for n, r in jobs.items() if r["status"] == "FAILED"} == {"torn.json.gz", "junk.json.gz"}
    assert all(r["error"] and not r["processed_lines"] for r in jobs.values() if r["status"] == "FAILED")
    assert {r["status"] for r in jobs.values()} == {"FAILED", "COMPLETED"}
    assert jobs["good.json.gz"]["processed_lines"] == 500
    assert store.records().where(F.col("arrival.file").contains("torn")).count() == 0
    assert counts(store)["packed"] == 500

    # The run again, as after a restart: nothing is read twice, failed jobs stay failed.
    ingest(spark, str(landing), base, run="one")
    again = {r["filename"]: r["status"] for r in store.jobs().collect()}
    assert again == {n: r["status"] for n, r in jobs.items()}
    # Mended, it is imported under a new run.
    (landing / "torn.json.gz").write_bytes(whole)
    assert ingest(spark, str(landing / "torn.json.gz"), base, run="two").processed_lines == 500


def test_a_run_of_unreadable_files_fails(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    for name in ("a.gz", "b.gz"):
        (folder / name).write_bytes(b"\x1f\x8b\x08 no")
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(Exception):
        ingest(spark, str(folder), store.base, run="one")
    assert {r["status"] for r in store.jobs().collect()} == {"FAILED"}
    assert store.runs().count() == 0


def test_bad_files_are_found_by_halving(spark, tmp_path, landing):
    files = [f"file://{p}" for p in sorted(landing.glob("*.jsonl"))]
    assert unreadable(spark, files) == {} and unreadable(spark, []) == {}
    gone = [f"file://{landing}/missing {k}" for k in range(2)]
    assert set(unreadable(spark, [*files[:3], gone[0], *files[3:], gone[1]])) == set(gone)


def test_lines_are_counted_while_a_run_is_written(spark, tmp_path, monkeypatch):
    folder = tmp_path / "landing"
    folder.mkdir()
    for k in range(6):
        (folder / f"{k}.jsonl").write_text("\n".join([entry(f"event {i}") for i in range(3000)]) + "\n")
    base = str(tmp_path / "store")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    plain = Store.write_lines

    def dying(self, lines, run):
        plain(self, lines, run)
        raise KeyboardInterrupt

    try:
        ingest(spark, str(folder), base, run="one", count_every=0.05)
        # A run that died while it was written: its jobs stand at the last count.
        monkeypatch.setattr(Store, "write_lines", dying)
        with pytest.raises(KeyboardInterrupt):
            ingest(spark, str(folder), base, run="two", count_every=0.05)
    finally:
        monkeypatch.undo()
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    store = Store(spark, base)
    taken = [r["lines"] for r in store.progress().where("run = 'one'").orderBy("at").collect()]
    assert len(set(taken)) > 2 and taken == sorted(taken) and 0 < taken[-1] <= 18_000
    last = store.progress().where("run = 'two'").agg(F.max("lines")).first()[0]
    jobs = store.jobs().where("run = 'two'").collect()
    assert {r["status"] for r in jobs} == {"RUNNING"}
    assert last - 6 <= sum(r["processed_lines"] for r in jobs) <= last
    one = store.jobs().where("run = 'one'")
    assert {(r["status"], r["processed_lines"]) for r in one.collect()} == {("COMPLETED", 3000)}
    status = ledger.import_status(one)
    assert {(r["percent"], r["terminal"]) for r in ledger.progress(status).collect()} == {(100, True)}
    with pytest.raises(ValueError):
        Watch(store, "x", lambda: datetime.now(timezone.utc), 0)


def files_below(folder):
    return len(list(folder.rglob("*.parquet"))) if folder.exists() else 0


def test_compaction_keeps_rows_and_bounds_files(spark, tmp_path, landing):
    store = Store(spark, str(tmp_path / "store"))

    def state():
        lines = store.lines().select("id", "run", "body", "outcome", "event_date", "error_code")
        return (
            sorted(map(str, lines.collect())),
            sorted(map(str, store.issues().collect())),
            sorted(map(str, store.jobs().collect())),
            sorted(map(str, store.runs().collect())),
            store.newest(),
        )

    assert compact(store) == 0 and vacuum(store) == 0
    for k in range(4):
        ingest(spark, str(landing / f"{k}.jsonl"), store.base, run=f"r{k}")
    before, held = state(), store.records()
    rows = held.count()
    assert compact(store) == 1 and state() == before
    assert compact(store) == 1  # nothing new
    # A reader from before goes on; a run that was never published stays out of sight.
    assert held.count() == rows == 10
    store.write_lines(store.run_lines("r1").drop("run"), "half")
    assert state() == before
    ingest(spark, str(landing / "5.jsonl"), store.base, run="r5")
    more = state()
    assert len(more[0]) == 16 and len(store.line_parts(store.generation())) == 1
    assert compact(store) == 2 and state() == more
    assert vacuum(store) > 0 and state() == more
    assert files_below(tmp_path / "store" / "runs") == files_below(tmp_path / "store" / "jobs") == 0
    assert [p.name for p in (tmp_path / "store" / "lines").iterdir() if p.is_dir()] == ["run=half"]
    assert files_below(tmp_path / "store" / "packed") == 1 + 3
    # The import goes on, and a merged run is still known.
    assert ingest(spark, str(landing / "5.jsonl"), store.base, run="r5").processed_lines == 6
    ingest(spark, str(landing / "6.jsonl"), store.base, run="r6")
    assert store.records().count() == 23 and store.run_lines("r5").count() == 6
    days = store.records().where("event_date = '2025-09-08'")
    assert days.count() == 23 and store.records().where("event_date = '2025-09-09'").count() == 0


def test_parts_join_like_digits(spark, tmp_path):
    """A small part is merged with its like; large ones are left alone."""
    store = Store(spark, str(tmp_path / "store"))
    (tmp_path / "big.jsonl").write_text("\n".join([entry(f"n {i}") for i in range(300)]))
    (tmp_path / "small.jsonl").write_text(entry("x"))
    ingest(spark, str(tmp_path / "big.jsonl"), store.base, run="big")
    sizes = []
    compact(store)
    for k in range(4):
        ingest(spark, str(tmp_path / "small.jsonl"), store.base, run=f"s{k}")
        compact(store)
        sizes.append([p["rows"] for p in store.line_parts(store.generation())])
    assert sizes == [[300, 1], [300, 2], [300, 3], [300, 1 + 3]] or sizes[-1][0] == 300 and len(sizes[-1]) <= 3
    assert store.records().count() == 304
