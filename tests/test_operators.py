"""Filters, lists, dashboard queries, issues and jobs on small tables."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logloom import schema
from logloom.operators import analytics, filters, integrity, issues, ledger, listing


def at(text):
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc)


@pytest.fixture
def records(spark):
    """Records from (time, severity, service, body, fingerprint, id) with later ones optional."""

    def make(*rows):
        full = []
        for i, row in enumerate(rows):
            when, severity, service, body, fp, key = (*row, *[None] * 6)[:6]
            key = key or f"00000000-0000-0000-0000-{i:012d}"
            full.append((key, at(when), severity, service, body or "b", fp or "fp", "{}"))
        frame = spark.createDataFrame(
            full,
            "id string, timestamp timestamp, severity_number int, service_name string,"
            "body string, fingerprint string, attributes string",
        )
        missing = [c for c in schema.LIST_COLUMNS if c not in frame.columns]
        return frame.withColumns({c: F.lit(None).cast("string") for c in missing})

    return make


@pytest.fixture
def known(spark):
    def make(*rows):
        full = []
        for row in rows:
            fp, first, severity, count, services = (*row, *[None] * 5)[:5]
            first = at(first or "2026-01-01T00:00:00Z")
            full.append(
                (fp, f"sample {fp}", severity, first, first, count or 1, services or [],
                 schema.UNRESOLVED, None, False)
            )
        return spark.createDataFrame(full, schema.ISSUES)

    return make


# --- dashboard


def test_error_rate(records):
    found = records(
        ("2026-01-01T10:05:00Z", 9), ("2026-01-01T10:15:00Z", 17), ("2026-01-01T10:59:59.999Z", 21),
        ("2026-01-01T13:00:00Z", None), ("2026-01-01T14:00:00Z", 17),
    )
    rows = analytics.error_rate(found, "2026-01-01T10:00:00Z", "2026-01-01T14:00:00Z").collect()
    assert [(r["total"], r["errors"]) for r in rows] == [(3, 2), (0, 0), (0, 0), (1, 0)]
    assert [r["ratio"] for r in rows] == [2 / 3, 0.0, 0.0, 0.0]
    minutes = analytics.error_rate(found, "2026-01-01T10:00:30Z", "2026-01-01T10:20:00Z")
    assert minutes.count() == 20
    assert analytics.error_rate(found, "2026-01-01T00:00:00Z", "2026-01-21T00:00:00Z").count() == 20
    inverted = analytics.error_rate(found, "2026-01-02T00:00:00Z", "2026-01-01T00:00:00Z")
    assert inverted.collect() == []
    with pytest.raises(ValueError):
        analytics.error_rate(found, "2026-01-01", "2026-01-02T00:00:00Z")


def test_by_service(records):
    found = records(
        ("2026-01-01T00:00:00Z", 17, "a"), ("2026-01-01T00:00:01Z", 9, "a"),
        ("2026-01-01T00:00:02Z", 17, None), ("2026-01-01T00:00:03Z", None, "unknown"),
        ("2026-01-01T00:00:04Z", 17, "unknown"), ("2026-01-02T00:00:00Z", 17, "late"),
    )
    rows = analytics.by_service(found, "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z").collect()
    assert [tuple(r) for r in rows] == [("unknown", 3, 2), ("a", 2, 1)]


def test_top_issues(records, known):
    found = records(
        *[("2026-01-01T00:00:00Z", 9, None, "m", fp) for fp, n in (("a", 5), ("b", 3), ("c", 1)) for _ in range(n)],
        ("2026-01-03T00:00:00Z", 9, None, "m", "c"),
    )
    window = ("2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z")
    issues_ = known(("a", None, 9, 99), ("b",), ("c",))
    top = analytics.top_issues(found, issues_, *window, limit=2).collect()
    assert [(r["fingerprint"], r["event_count"]) for r in top] == [("a", 5), ("b", 3)]
    # The cut comes before the join: a fingerprint without an issue uses up its place.
    assert analytics.top_issues(found, known(("b",)), *window, limit=1).collect() == []
    for bad in (0, 51, "x", True):
        with pytest.raises(ValueError):
            analytics.top_issues(found, issues_, *window, limit=bad)


def test_spikes(records, known):
    def many(when, fp, n):
        return [(when, 9, None, "m", fp)] * n

    found = records(
        *many("2026-01-01T02:00:00Z", "up", 6), *many("2026-01-01T01:00:00Z", "up", 2),
        *many("2026-01-01T02:30:00Z", "flat", 3), *many("2026-01-01T01:30:00Z", "flat", 2),
        *many("2026-01-01T02:30:00Z", "new", 9),
        *many("2026-01-01T02:10:00Z", "edge", 3), *many("2026-01-01T00:59:59.999Z", "edge", 1),
        *many("2026-01-01T02:10:00Z", "lost", 3), *many("2026-01-01T01:10:00Z", "lost", 1),
    )
    rows = analytics.spikes(
        found, known(("up", None, 9, 8, ["s"]), ("flat",), ("new",), ("edge",)),
        "2026-01-01T02:00:00Z", "2026-01-01T03:00:00Z",
    ).collect()
    assert [(r["fingerprint"], r["current_count"], r["previous_count"], r["multiplier"]) for r in rows] == [
        ("up", 6, 2, 3.0)
    ]


def test_new_issues(known):
    found = known(
        ("old", "2025-12-31T23:59:59.999Z"), ("a", "2026-01-01T00:00:00Z"),
        ("b", "2026-01-01T12:00:00Z"), ("late", "2026-01-02T00:00:00Z"),
    )
    rows = analytics.new_issues(found, "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z").collect()
    assert [r["fingerprint"] for r in rows] == ["b", "a"]


# --- lists


def walk(found, **params):
    seen, cursor = [], None
    while True:
        page = listing.list_logs(found, cursor=cursor, **params)
        seen += [row["id"][:4] for row in page.records]
        cursor = page.next_cursor
        if cursor is None:
            return seen


def test_pages_with_equal_times(records):
    keys = ("3333", "2222", "1111", "4444", "5555")
    times = ["2026-05-01T00:00:00Z"] * 3 + ["2026-04-01T00:00:00Z", "2026-03-01T00:00:00Z"]
    found = records(
        *[(t, 9, None, "b", "f", f"{k}{k}-{k}-{k}-{k}-{k}{k}{k}") for t, k in zip(times, keys)]
    )
    assert walk(found, limit=2) == list(keys)
    assert walk(found, limit=5) == list(keys)
    page = listing.list_logs(found, limit=200)
    assert "raw" not in page.records[0] and page.next_cursor is None


def test_log_filters(records):
    found = records(
        ("2026-02-01T00:00:00Z", 9, "checkout", "Connection timeout 100%"),
        ("2026-02-02T00:00:00Z", None, "billing", "user logged in"),
        ("2026-02-03T00:00:00Z", 17, "checkout", "TIMEOUT waiting"),
    )

    def bodies(**params):
        return [row["body"][:4] for row in listing.list_logs(found, **params).records]

    assert bodies(q="timeout") == ["TIME", "Conn"]
    assert len(bodies(q="ab")) == len(bodies(q="")) == 3
    assert bodies(q="100%") == ["Conn"] and bodies(q="t%m") == []
    assert bodies(level=["unknown"]) == ["user"]
    assert bodies(level=["unknown", 9]) == ["user", "Conn"]
    assert bodies(level="17") == ["TIME"] and len(bodies(level=[])) == 3
    assert bodies(service="checkout", level=[17]) == ["TIME"]
    assert bodies(service="Checkout") == []
    assert bodies(start="2026-02-02T00:00:00Z") == ["TIME", "user"]
    assert bodies(end="2026-02-03T00:00:00Z") == ["user", "Conn"]
    assert bodies(start="2026-02-03T00:00:00Z", end="2026-02-01T00:00:00Z") == []
    assert walk(found, service="checkout", limit=1) == ["0000", "0000"]


@pytest.mark.parametrize(
    "params",
    [
        {"limit": 0}, {"limit": 201}, {"level": 25}, {"level": ["x"]}, {"level": [0]}, {"service": ""},
        {"start": "2026-02-01"}, {"cursor": "nonsense"}, {"cursor": "e30"}, {"cursor": ""},
    ],
)
def test_bad_list_arguments(records, params):
    with pytest.raises(ValueError):
        listing.list_logs(records(("2026-02-01T00:00:00Z", 9)), **params)


def test_list_issues(spark, known):
    many = known(*[(f"f{i:03d}", "2026-01-01T00:00:00Z", 9, 1, ["a"]) for i in range(501)])
    assert listing.list_issues(many).count() == 500
    some = known(
        ("x", "2026-01-01T00:00:00Z", 17, 1, ["a", "b"]), ("y", "2026-01-02T00:00:00Z", None, 1, ["b"]),
        ("z", "2026-01-03T00:00:00Z", 9),
    )

    def keys(**params):
        return [r["fingerprint"] for r in listing.list_issues(some, **params).collect()]

    assert keys() == ["z", "y", "x"]
    assert keys(service="b") == ["y", "x"] and keys(service="b", severity=17) == ["x"]
    assert keys(severity=["unknown", 9]) == ["z", "y"]
    assert listing.issue(some, "y").count() == 1 and listing.issue(some, "q").count() == 0


def test_attribute_filters(spark):
    rows = ['{"a":"x","n":5,"o":{"k":1},"d.t":true}', '{"a":"5","n":"5"}', "{}"]
    frame = spark.createDataFrame([(r,) for r in rows], "attributes string")

    def count(clause):
        return frame.where(clause).count()

    assert count(filters.attribute_exists("a")) == 2
    assert count(filters.attribute_exists("d.t")) == 1
    assert count(filters.attribute_is("n", 5)) == 1
    assert count(filters.attribute_is("n", "5")) == 1
    assert count(filters.attributes_contain({"a": "x", "n": 5, "d.t": True})) == 1


# --- issues


def occurrence(spark, *rows):
    """(fingerprint, service, time, severity) in order of arrival."""
    full = [
        (fp, f"m{i}", severity, service, at(when), ("f", 0, i, 0))
        for i, (fp, service, when, severity) in enumerate(rows)
    ]
    return spark.createDataFrame(
        full,
        "fingerprint string, message string, severity_number int, service_name string,"
        "occurred_at timestamp, arrival struct<file:string,block:bigint,row:bigint,event:int>",
    )


def test_fold_follows_arrival(spark):
    found = occurrence(
        spark,
        ("a", "s2", "2026-01-01T10:00:00Z", 17), ("a", None, "2026-01-01T12:00:00Z", 17),
        ("a", "s1", "2026-01-01T09:00:00Z", 9), ("a", "s2", "2026-01-01T11:00:00Z", 17),
        ("b", None, "2026-01-01T09:00:00Z", None),
    ).repartition(3)
    a, b = issues.fold(found).orderBy("fingerprint").collect()
    assert (a["event_count"], a["sample_message"], a["severity_number"]) == (4, "m0", 17)
    assert a["affected_services"] == ["s2", "s1"] and b["affected_services"] == []
    spans = issues.fold(found).where("fingerprint = 'a'").select(
        F.date_format("first_seen", "HH"), F.date_format("last_seen", "HH")
    )
    assert tuple(spans.first()) == ("10", "12")


def test_fold_needs_no_sort(spark):
    found = occurrence(spark, ("a", "s", "2026-01-01T10:00:00Z", 17))
    plan = issues.fold(found)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("ObjectHashAggregate") == 4


def test_merge_keeps_the_stored_issue(spark, known):
    stored = known(("a", "2026-01-01T00:00:00Z", None, 2, ["x"]), ("r",), ("i",), ("idle",))
    stored = stored.withColumns(
        {
            "status": F.when(F.col("fingerprint") == "r", schema.RESOLVED)
            .when(F.col("fingerprint") == "i", schema.IGNORED)
            .otherwise(F.col("status")),
            "resolved_at": F.when(F.col("fingerprint").isin("r", "i"), F.col("first_seen")),
        }
    )
    day = "2026-02-01T00:00:00Z"
    merged = issues.upsert(
        stored,
        occurrence(spark, ("a", "y", day, 17), ("r", None, day, 9), ("i", None, day, 9), ("new", None, day, 9)),
    )
    rows = {row["fingerprint"]: row for row in merged.collect()}
    assert set(rows) == {"a", "r", "i", "idle", "new"}
    a = rows["a"]
    assert (a["severity_number"], a["sample_message"], a["event_count"]) == (None, "sample a", 3)
    assert a["affected_services"] == ["x", "y"] and a["last_seen"] > a["first_seen"]
    back = rows["r"]
    assert (back["status"], back["resolved_at"], back["regression"]) == ("unresolved", None, True)
    assert rows["i"]["status"] == "ignored" and rows["i"]["resolved_at"] is not None
    assert rows["idle"]["event_count"] == 1
    assert (rows["new"]["status"], rows["new"]["regression"]) == ("unresolved", False)


def test_folding_in_parts_equals_folding_at_once(spark):
    rows = [(f"f{i % 3}", f"s{i % 4}", f"2026-01-01T{i % 24:02d}:00:00Z", 9) for i in range(40)]
    whole = occurrence(spark, *rows)
    first, second = whole.where("arrival.row < 17"), whole.where("arrival.row >= 17")
    at_once = issues.opened(issues.fold(whole)).orderBy("fingerprint").collect()
    empty = spark.createDataFrame([], schema.ISSUES)
    parts = issues.upsert(issues.upsert(empty, first), second).orderBy("fingerprint")
    assert [r.asDict() for r in parts.collect()] == [r.asDict() for r in at_once]


def step(state, action, when):
    status, resolved_at, regression = state
    if action == "ignore":
        return ("ignored", resolved_at, regression), True
    if action == "resolve" and status == "unresolved":
        return ("resolved", when, False), True
    if action == "reopen" and status == "ignored":
        return ("unresolved", None, regression), True
    return state, False


def test_actions_agree_with_stepping(spark):
    import random

    chance = random.Random(5)
    state, rows = {}, []
    for n in range(30):
        status = chance.choice(schema.STATUSES)
        state[f"f{n}"] = (status, at("2025-12-01T00:00:00Z") if status != "unresolved" else None, chance.random() < 0.5)
    stored = spark.createDataFrame(
        [(fp, *s) for fp, s in state.items()],
        "fingerprint string, status string, resolved_at timestamp, regression boolean",
    )
    for i in range(400):
        when = at(f"2026-01-{1 + i // 80:02d}T{i % 24:02d}:{i % 60:02d}:00Z").replace(microsecond=i)
        rows.append((f"f{chance.randrange(31)}", chance.choice(issues.ACTIONS), when))
    expected_refused = 0
    for fp, action, when in sorted(rows, key=lambda r: r[2]):
        if fp not in state:
            expected_refused += 1
            continue
        state[fp], accepted = step(state[fp], action, when)
        expected_refused += not accepted
    changed, refused = issues.apply_actions(
        stored, spark.createDataFrame(rows, "fingerprint string, action string, at timestamp")
    )
    got = {
        r["fingerprint"]: (r["status"], r["micros"], r["regression"])
        for r in changed.withColumn("micros", F.unix_micros("resolved_at")).collect()
    }
    wanted = {
        fp: (s, None if t is None else round(t.timestamp() * 1_000_000), g) for fp, (s, t, g) in state.items()
    }
    assert got == wanted
    assert refused.count() == expected_refused


def test_integrity(records, known, spark):
    found = records(("2026-01-01T00:00:00Z", 9, None, "m", "a"), ("2026-01-01T00:00:00Z", 9, None, "m", "b"))
    assert integrity.records_without_issue(found, known(("a",))).count() == 1
    jobs = spark.createDataFrame([("j",)], "id string")
    assert integrity.records_without_job(found.withColumn("import_job_id", F.lit("j")), jobs).count() == 0


# --- jobs

JOB = "00000000-0000-4000-8000-00000000000{}"


def jobs(spark, *rows):
    full = []
    for i, (status, total, processed, errors, elapsed) in enumerate(rows):
        row = dict.fromkeys(f.name for f in schema.JOBS)
        row.update(
            id=JOB.format(i), filename="f", status=status, total_lines=total, processed_lines=processed,
            parse_errors=errors, elapsed_ms=elapsed, created_at=at("2026-01-01T00:00:00Z"), step=1,
            updated_at=at("2026-01-01T00:00:00Z"),
        )
        full.append(tuple(row.values()))
    return spark.createDataFrame(full, schema.JOBS)


def test_import_status(spark):
    found = jobs(
        spark, ("COMPLETED", 1000, 1000, 10, 2000), ("RUNNING", 500, 120, 3, None),
        ("COMPLETED", 7, 7, 0, 0), ("FAILED", None, None, None, 5), ("COMPLETED", 3, 3, 0, 2000),
    )
    done = ledger.get_import(found, JOB.format(0))
    assert (done["ingested_records"], done["elapsed_ms"], done["lines_per_second"]) == (990, 2000, 500)
    running = ledger.get_import(found, JOB.format(1))
    assert (running["status"], running["ingested_records"], running["finished_at"]) == ("running", None, None)
    assert ledger.get_import(found, JOB.format(2))["lines_per_second"] == 7
    failed = ledger.get_import(found, JOB.format(3))
    assert (failed["status"], failed["processed_lines"], failed["lines_per_second"]) == ("failed", 0, None)
    # Half a line per second counts as a whole one.
    assert ledger.get_import(found, JOB.format(4))["lines_per_second"] == 2
    with pytest.raises(ledger.JobNotFound):
        ledger.get_import(found, JOB.format(9))
    with pytest.raises(ValueError):
        ledger.get_import(found, "x")
    shown = ledger.progress(ledger.import_status(found)).orderBy("id").collect()
    assert [(r["percent"], r["terminal"]) for r in shown] == [
        (100, True), (24, False), (100, True), (None, True), (100, True),
    ]
    assert ledger.list_imports(found).columns == [
        "id", "filename", "status", "created_at", "total_lines", "processed_lines", "parse_errors",
    ]


def test_ledger_keeps_the_latest_row(spark):
    start = jobs(spark, ("PENDING", None, None, None, None))
    at_ = F.lit("2026-01-01 00:00:00").cast("timestamp")
    rows = ledger.transition(start, schema.PENDING, at_)
    rows = rows.unionByName(ledger.transition(start, schema.RUNNING, at_))
    rows = rows.unionByName(
        ledger.transition(start, schema.RUNNING, at_, progress=True, processed_lines=F.lit(5))
    )
    latest = ledger.latest(rows).first()
    assert (latest["status"], latest["processed_lines"]) == ("RUNNING", 5)
    rows = rows.unionByName(ledger.transition(start, schema.FAILED, at_, error=F.lit("disk full")))
    latest = ledger.latest(rows).first()
    assert (latest["status"], latest["error"]) == ("FAILED", "disk full")
    assert latest["finished_at"] is not None


def test_search_from_the_newest_record(records):
    found = records(
        *[(f"2026-05-{30 - i // 2:02d}T00:00:00Z", 9) for i in range(20)],
        *[(f"2025-0{1 + i}-01T00:00:00Z", 17) for i in range(5)],
    )
    newest = at("2026-05-30T00:00:00Z")
    for limit in (1, 3, 7, 50):
        for extra in ({}, {"level": 17}, {"end": "2026-05-25T00:00:00Z"}, {"start": "2026-05-28T00:00:00Z"}):
            plain = listing.list_logs(found, limit=limit, **extra)
            near = listing.list_logs(found, limit=limit, newest=newest, **extra)
            assert near == plain
            if limit > 1 and plain.next_cursor:
                cursor = plain.next_cursor
                seen = listing.list_logs(found, limit=limit, newest=newest, cursor=cursor, **extra)
                assert seen == listing.list_logs(found, limit=limit, cursor=cursor, **extra)
