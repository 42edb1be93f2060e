"""Import of log files into the store."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import schema
from logloom.functions.fingerprint import record_id
from logloom.functions.times import instant_lit, parse_instant
from logloom.operators import issues as issue_ops
from logloom.operators import ledger, records
from logloom.plans.progress import Watch
from logloom.plans.store import RECORD, Store
from logloom.session import configure
from logloom.sources import lines as line_ops
from logloom.sources import registry
from logloom.sources.base import LogSource


class EmptyInput(ValueError):
    """There is nothing to import."""


@dataclass(frozen=True)
class Outcome:
    run: str
    processed_lines: int
    parse_errors: int
    ingested_records: int
    elapsed_ms: int
    failed_files: int = 0


def job_id(run: str, file: Column) -> Column:
    """Every file is a job of its own; its id follows from the run and the path."""
    return record_id(F.lit(run), file)


def file_name(file: Column) -> Column:
    """Last part of a file's address, as it is called on the file system."""
    last = F.regexp_extract(file, r"([^/]+)\z", 1)
    return F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))


def choose_formats(
    spark: SparkSession,
    paths: str | list[str],
    sources: Sequence[LogSource] = registry.SOURCES,
    fallback: LogSource = registry.FALLBACK,
) -> dict[str, str | list[str]]:
    """What to read with each format: the given paths if all files have one, else files by format.

    Of the contents only the first lines of each file are read. Files come to the
    driver by name only where formats are mixed.
    """
    heads = line_ops.expand_envelopes(line_ops.read_heads(spark, paths))
    found = registry.detect(heads, sources, fallback).select("file", "source_type")
    files = line_ops.file_sizes(spark, paths).select("file")
    kind = F.coalesce("source_type", F.lit(fallback.source_type)).alias("source_type")
    named = files.join(found, "file", "left").select("file", kind)
    kinds = [row["source_type"] for row in named.select("source_type").distinct().collect()]
    if len(kinds) == 1:
        return {kinds[0]: paths}
    grouped: dict[str, str | list[str]] = {}
    for row in named.groupBy("source_type").agg(F.collect_set("file").alias("files")).collect():
        grouped[row["source_type"]] = [line_ops.literal(unquote(f)) for f in sorted(row["files"])]
    return grouped


def parse_files(
    spark: SparkSession,
    paths_by_type: dict[str, str | list[str]],
    sources: Sequence[LogSource] = registry.SOURCES,
) -> DataFrame:
    """Drafts of all files; every file is scanned once, by the parser of its format."""
    return registry.route(
        {
            name: line_ops.expand_envelopes(line_ops.scan_lines(spark, paths))
            for name, paths in paths_by_type.items()
        },
        sources,
    )


def totals_by_job(lines: DataFrame) -> DataFrame:
    return records.run_totals(lines, "import_job_id")


def fold_run(store: Store, run: str) -> DataFrame:
    """Issues of one run, read back from its written records.

    Only the columns the fold needs are read; the lines are not parsed again.
    """
    written = store.run_lines(run).where(F.col("outcome") == RECORD)
    return issue_ops.fold(records.occurrences(written))


def commit_run(store: Store, run: str, at: datetime, failed: Sequence[str] = ()) -> DataFrame:
    """Merge the run's issues into the buckets they fall into and publish both together."""
    version, parts = store.issues_version(), store.issue_parts()
    folded = store.write_fold(fold_run(store, run), run)
    touched = store.touched(folded, len(parts))
    merged = issue_ops.merge(store.issues(buckets=touched), folded)
    parts = store.write_issues(merged, version + 1, parts, touched)
    totals = store.run_lines(run).agg(
        F.count(F.lit(1)).alias("processed_lines"),
        F.count_if(F.col("outcome") != RECORD).alias("parse_errors"),
        F.min("timestamp").alias("first_event"),
        F.max("timestamp").alias("last_event"),
    )
    store.write_rollups(run)
    store.publish(run, version + 1, parts, totals, at, failed, rolled=True)
    return store.runs().where(F.col("run") == run)


def unreadable(spark: SparkSession, files: Sequence[str]) -> dict[str, str]:
    """Files that cannot be read to their end, with the reason.

    Found by halving: a set that is read without an error is done with, so a few bad
    files among many cost little more than one more reading of all.
    """
    bad: dict[str, str] = {}
    left = [list(files)] if files else []
    while left:
        part = left.pop()
        try:
            lines = spark.read.text([line_ops.literal(unquote(f)) for f in part])
            lines.agg(F.sum(F.length("value"))).collect()
        except Exception as error:
            if len(part) == 1:
                bad[part[0]] = _reason(error)
            else:
                left += [part[: len(part) // 2], part[len(part) // 2 :]]
    return bad


def _reason(error: Exception) -> str:
    return str(error).splitlines()[0] if str(error) else type(error).__name__


def ingest(
    spark: SparkSession,
    paths: str | list[str],
    base: str,
    *,
    source_type: str | None = None,
    run: str | None = None,
    now: datetime | None = None,
    sources: Sequence[LogSource] = registry.SOURCES,
    fallback: LogSource = registry.FALLBACK,
    count_every: float = 10.0,
) -> Outcome:
    """Import files: detect, parse, store records and rejects, update issues.

    A run name that is already published is left alone, so a repeated call does
    no harm. Importing the same files under a new run counts them again.

    A file that cannot be read fails alone: its job is marked failed with the reason,
    none of its lines are stored, and the run goes on with the others. If no file can
    be read, or the failure is not that of a file, the run fails and is not published.
    While lines are written, they are counted every ``count_every`` seconds for the
    ledger.
    """
    configure(spark)
    registry.check_source_type(source_type, sources)
    run = run or uuid.uuid4().hex
    now = parse_instant(now or datetime.now(timezone.utc))
    store = Store(spark, base)
    files = line_ops.file_sizes(spark, paths)
    size = files.agg(F.sum("size_bytes")).first()[0]
    if not size:
        raise EmptyInput("the input holds no bytes")
    opened = files.select(
        job_id(run, F.col("file")).alias("id"),
        F.lit(run).alias("run"),
        file_name(F.col("file")).alias("filename"),
        F.col("file").alias("storage_key"),
        "size_bytes",
        F.lit(source_type).alias("source_type"),
    )
    at = instant_lit(now)
    if store.is_published(run):
        # The run may have ended between its publication and the closing of its jobs.
        close_jobs(store, run, _without(opened, store.failed_files(run)), now, now, None)
        return _outcome(store, run)

    started = time.monotonic()
    store.append_jobs(
        ledger.transition(opened, schema.PENDING, at).unionByName(
            ledger.transition(opened, schema.RUNNING, at, created_at=at)
        )
    )
    # From here on jobs are those of the ledger: a file may be gone by now.
    running = (F.col("run") == run) & (F.col("step") == ledger.STEPS[schema.RUNNING])
    opened = ledger.latest(store.transitions().where(running))

    def ended() -> datetime:
        return now + timedelta(milliseconds=int((time.monotonic() - started) * 1000))

    def write(chosen: str | list[str]) -> None:
        grouped = (
            choose_formats(spark, chosen, sources, fallback)
            if source_type is None
            else {source_type: chosen}
        )
        drafts = parse_files(spark, grouped, sources)
        whole = records.assemble(drafts, now, job_id(run, F.col("arrival.file")))
        with Watch(store, run, ended, count_every):
            store.write_lines(whole, run)

    failed: dict[str, str] = {}
    try:
        try:
            write(paths)
        except Exception:
            listed = [row["storage_key"] for row in opened.select("storage_key").collect()]
            failed = unreadable(spark, listed)
            good = [line_ops.literal(unquote(f)) for f in sorted(listed) if f not in failed]
            if not failed or not good:
                raise
            write(good)
        _fail(store, opened, failed, ended(), now)
        good_jobs = _without(opened, failed)
        # The lines are written; what is left of the run is to publish them.
        store.append_jobs(progress_rows(store, run, good_jobs, now, ended()))
        commit_run(store, run, now, sorted(failed))
    except Exception as error:
        left = opened.select("storage_key").collect()
        _fail(store, opened, {r[0]: failed.get(r[0], _reason(error)) for r in left}, ended(), now)
        raise
    elapsed = int((time.monotonic() - started) * 1000)
    close_jobs(store, run, good_jobs, now, now + timedelta(milliseconds=elapsed), elapsed)
    return _outcome(store, run, elapsed)


def _without(jobs: DataFrame, failed: Iterable[str]) -> DataFrame:
    return jobs.where(~F.col("storage_key").isin(list(failed)))


def _fail(store: Store, jobs: DataFrame, reasons: dict[str, str], at: datetime, created: datetime) -> None:
    """Mark the jobs of the given files as failed, each with its reason."""
    if not reasons:
        return
    why = store.spark.createDataFrame(list(reasons.items()), "storage_key string, why string")
    store.append_jobs(
        ledger.transition(
            jobs.join(F.broadcast(why), "storage_key"),
            schema.FAILED,
            instant_lit(at),
            created_at=instant_lit(created),
            error=F.col("why"),
        )
    )


def _with_totals(store: Store, run: str, jobs: DataFrame) -> DataFrame:
    """Jobs with their lines and errors; a file without lines has none of either."""
    per_job = totals_by_job(store.run_lines(run)).withColumnRenamed("import_job_id", "id")
    known = jobs.drop("processed_lines", "parse_errors")
    return known.join(per_job, "id", "left").fillna(0, ["processed_lines", "parse_errors"])


def progress_rows(
    store: Store, run: str, jobs: DataFrame, created: datetime, at: datetime
) -> DataFrame:
    """Ledger rows of jobs whose lines are written but not yet published."""
    return ledger.transition(
        _with_totals(store, run, jobs),
        schema.RUNNING,
        instant_lit(at),
        progress=True,
        created_at=instant_lit(created),
        total_lines=F.col("processed_lines"),
    )


def close_jobs(
    store: Store,
    run: str,
    jobs: DataFrame,
    created: datetime,
    at: datetime,
    elapsed: int | None,
) -> None:
    """Mark the jobs of a published run as completed, unless they are so already.

    Files of a run are read together, so the time of a job is that of its run, from
    its opening to its end; it is not known of a run that was interrupted.
    """
    done = store.transitions().where(F.col("status") == schema.COMPLETED).select("id")
    left = jobs.join(done, "id", "left_anti")
    if left.isEmpty():
        return
    opening = store.transitions().where(F.col("run") == run).groupBy("id")
    opening = opening.agg(F.min("created_at").alias("opened_at"))
    whole = _with_totals(store, run, left).join(opening, "id", "left")
    store.append_jobs(
        ledger.transition(
            whole,
            schema.COMPLETED,
            instant_lit(at),
            created_at=F.coalesce("opened_at", instant_lit(created)),
            total_lines=F.col("processed_lines"),
            elapsed_ms=F.lit(elapsed),
        )
    )


def _outcome(store: Store, run: str, elapsed: int | None = None) -> Outcome:
    row = store.runs().where(F.col("run") == run).first()
    if elapsed is None:
        jobs = store.jobs().where(F.col("run") == run)
        elapsed = jobs.agg(F.max("elapsed_ms")).first()[0] or 0
    return Outcome(
        run,
        row["processed_lines"],
        row["parse_errors"],
        row["processed_lines"] - row["parse_errors"],
        elapsed,
        len(row["failed"] or ()),
    )


def reprocess(
    store: Store, sources: Sequence[LogSource] = registry.SOURCES, run: str | None = None
) -> DataFrame:
    """Parse the stored lines (of one run) again from their raw text, under the rules of today."""
    stored = store.lines() if run is None else store.lines().where(F.col("run") == run)
    parsed = [
        source.parse(
            stored.where(F.col("source_type") == source.source_type).select(
                "arrival", F.col("raw").alias("value")
            )
        )
        for source in sources
    ]
    return reduce(DataFrame.unionByName, parsed)


def reprocess_into(
    store: Store,
    base: str,
    now: datetime | None = None,
    sources: Sequence[LogSource] = registry.SOURCES,
) -> Store:
    """All imports of ``store`` again, as a store of its own below ``base``.

    Records, rejects, fingerprints and issues are what today's rules make of the
    stored lines; runs, jobs and places of lines stay the same. Runs already there
    are left alone, so an interrupted call can be repeated. State changes that users
    made are not carried over, since fingerprints may differ.
    """
    configure(store.spark)
    now = parse_instant(now or datetime.now(timezone.utc))
    target = Store(store.spark, base)
    imports = store.runs().where("processed_lines > 0").orderBy("issues_version", "run")
    for row in imports.select("run").collect():
        run = row["run"]
        if target.is_published(run):
            continue
        drafts = reprocess(store, sources, run)
        target.write_lines(records.assemble(drafts, now, job_id(run, F.col("arrival.file"))), run)
        commit_run(target, run, now)
    return target
