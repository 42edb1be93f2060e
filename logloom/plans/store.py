"""Tables on shared storage, published run by run.

Layout under the base folder::

    lines/run=<run>/outcome=<record|reject>/event_date=<day>/...   append only
    minutes/run=<run>/event_date=<day>/...      counts of a run's records per minute
    days/run=<run>/event_date=<day>/...            the same per day and host
    folds/run=<run>/...                            issues of one run alone
    issues/version=<n>/bucket=<b>/...   buckets of issues that version n rewrote
    jobs/...                                     one row per job transition
    progress/run=<run>/...                  counts taken while a run is written
    refused/run=<run>/...                          actions that could not be taken
    runs/...                                     one row per published run
    packed/..., rolled/...         what ``compaction`` has merged, and its counts

Readers follow the ``runs`` table only, so the records and issues of a run
appear together and a run that died half way is never seen. Issues are dealt over
buckets by a hash of their fingerprint; the row of a run says in which version each
bucket was last written, so a commit rewrites the buckets it touches and no others.
One writer at a time is assumed, as with any plain Parquet table.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom import schema
from logloom.functions.times import instant_lit, parse_instant
from logloom.operators import ledger, rollups

RECORD, REJECT = "record", "reject"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

#: Buckets of issues in a new store; an existing one keeps its number.
ISSUE_BUCKETS = 32

RUNS = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("issues_version", T.LongType()),
        T.StructField("processed_lines", T.LongType()),
        T.StructField("parse_errors", T.LongType()),
        T.StructField("first_event", T.TimestampType()),
        T.StructField("last_event", T.TimestampType()),
        T.StructField("published_at", T.TimestampType()),
        # The version that last wrote each bucket of issues; 0 where none has.
        T.StructField("issue_parts", T.ArrayType(T.LongType())),
        # Files that could not be read.
        T.StructField("failed", T.ArrayType(T.StringType())),
        # Whether the run's records are counted in the rollups; runs of older stores are not.
        T.StructField("rolled", T.BooleanType()),
    ]
)

REFUSED = T.StructType(
    [
        T.StructField("fingerprint", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("status", T.StringType()),
    ]
)

PROGRESS = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("lines", T.LongType()),
        T.StructField("tasks_done", T.LongType()),
        T.StructField("tasks", T.LongType()),
    ]
)

FOLDED = T.StructType([f for f in schema.ISSUES if f.name not in ("status", "resolved_at", "regression")])
_MANIFEST = "manifest.json"


class Store:
    def __init__(self, spark: SparkSession, base: str, issue_buckets: int = ISSUE_BUCKETS):
        if issue_buckets < 1:
            raise ValueError("issue_buckets must be at least 1")
        self.spark = spark
        self.base = base.rstrip("/")
        self.issue_buckets = issue_buckets

    # --- files ---

    def _path(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return target, files

    def _exists(self, path: str) -> bool:
        target, files = self._path(path)
        return files.exists(target)

    def _names(self, path: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        target, files = self._path(path)
        return [f.getPath().getName() for f in files.listStatus(target)] if files.exists(target) else []

    def delete(self, path: str) -> None:
        target, files = self._path(path)
        files.delete(target, True)

    def write_text(self, path: str, text: str) -> None:
        """A small file from the driver. It appears whole, under its name, or not at all."""
        target, files = self._path(path)
        hidden, _ = self._path(f"{path}._writing")
        out = files.create(hidden, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if files.exists(target):
            files.delete(target, False)
        files.rename(hidden, target)

    def read_text(self, path: str) -> str:
        return self.spark.read.option("wholetext", True).text(path).first()[0]

    # --- generations ---

    def generation(self) -> int:
        """Newest finished compaction, 0 if there is none."""
        found = [0]
        for name in self._names(f"{self.base}/packed"):
            number = name.removeprefix("generation=")
            if number.isdigit() and self._exists(f"{self.base}/packed/{name}/{_MANIFEST}"):
                found.append(int(number))
        return max(found)

    def generation_path(self, generation: int) -> str:
        return f"{self.base}/packed/generation={generation}"

    def line_parts(self, generation: int) -> list[dict]:
        """Parts that hold the merged lines, each with ``name`` and ``rows``, largest first."""
        if not generation:
            return []
        return json.loads(self.read_text(f"{self.generation_path(generation)}/{_MANIFEST}"))["parts"]

    def publish_generation(self, generation: int, parts: Sequence[dict]) -> None:
        self.write_text(f"{self.generation_path(generation)}/{_MANIFEST}", json.dumps({"parts": list(parts)}))

    def loose(self, table: str, columns: T.StructType, generation: int) -> DataFrame:
        """Rows of a table in files that no compaction has merged, with ``_file`` beside."""
        path = f"{self.base}/{table}"
        if not self._exists(path):
            return self.spark.createDataFrame([], columns).withColumn("_file", F.lit(""))
        found = self.spark.read.schema(columns).parquet(path)
        found = found.withColumn("_file", F.col("_metadata.file_path"))
        if not generation:
            return found
        merged = self.spark.read.schema("_file string").parquet(f"{self.generation_path(generation)}/sources")
        return found.join(merged, "_file", "left_anti")

    def _table(self, table: str, columns: T.StructType) -> DataFrame:
        generation = self.generation()
        rest = self.loose(table, columns, generation).drop("_file")
        if not generation:
            return rest
        packed = self.spark.read.schema(columns).parquet(f"{self.generation_path(generation)}/{table}")
        return packed.unionByName(rest)

    # --- reading ---

    def runs(self) -> DataFrame:
        return self._table("runs", RUNS)

    def is_published(self, run: str) -> bool:
        return not self.runs().where(F.col("run") == run).isEmpty()

    def failed_files(self, run: str) -> list[str]:
        """Files of a published run that could not be read."""
        row = self.runs().where(F.col("run") == run).select("failed").first()
        return list(row[0] or []) if row else []

    def _loose_lines(self) -> DataFrame:
        path = f"{self.base}/lines"
        if not self._exists(path):
            return self.spark.createDataFrame([], schema.LINES)
        return self.spark.read.schema(schema.LINES).parquet(path)

    def packed_lines(self, parts: Iterable[dict]) -> DataFrame:
        paths = [f"{self.base}/packed/{part['name']}" for part in parts]
        return reduce(
            DataFrame.unionByName, [self.spark.read.schema(schema.LINES).parquet(path) for path in paths]
        )

    def lines(self) -> DataFrame:
        """All lines of published runs; filters on run, outcome and day prune files."""
        generation = self.generation()
        if not generation:
            return self._loose_lines().join(self.runs().select("run"), "run", "left_semi")
        # Runs since the last compaction, by name: merged ones must not even be listed.
        recent = [r["run"] for r in self.loose("runs", RUNS, generation).select("run").collect()]
        found = [self.packed_lines([part]) for part in self.line_parts(generation)]
        if recent or not found:
            found.append(self._loose_lines().where(F.col("run").isin(recent)))
        return reduce(DataFrame.unionByName, found)

    def newest(self) -> datetime | None:
        """Time of the newest record, from the table of runs."""
        micros = self.runs().agg(F.unix_micros(F.max("last_event"))).first()[0]
        return None if micros is None else EPOCH + timedelta(microseconds=micros)

    def run_lines(self, run: str) -> DataFrame:
        """Lines of one run, published or not."""
        if not self._exists(f"{self.base}/lines/run={run}") and self.generation():
            return self.lines().where(F.col("run") == run)
        return self._loose_lines().where(F.col("run") == run)

    def records(self) -> DataFrame:
        return (
            self.lines()
            .where(F.col("outcome") == RECORD)
            .select(*schema.RECORD_COLUMNS, "event_date")
        )

    def _loose_rolled(self, counted: bool) -> DataFrame:
        """Names of runs that no compaction has merged, with or without rollups."""
        has = F.coalesce("rolled", F.lit(False)) == counted
        runs = self.loose("runs", RUNS, self.generation())
        return runs.where(has & (F.col("processed_lines") > 0)).select("run")

    def loose_rollup(self, kind: str) -> DataFrame:
        """Rollup of the runs that no compaction has merged."""
        columns = rollups.ROLLUPS[kind]
        path = f"{self.base}/{kind}"
        if not self._exists(path):
            return self.spark.createDataFrame([], columns)
        found = self.spark.read.schema(T.StructType([*columns, T.StructField("run", T.StringType())])).parquet(path)
        return found.join(self._loose_rolled(True), "run", "left_semi").select(*columns.names)

    def packed_rollup(self, kind: str, part: dict) -> DataFrame:
        return self.spark.read.schema(rollups.ROLLUPS[kind]).parquet(f"{self.base}/rolled/{rollup_name(kind, part)}")

    def rollup(self, kind: str) -> DataFrame:
        """Counts of the records of all runs that have them; a key may occur once per run."""
        parts = [part for part in self.line_parts(self.generation()) if part.get("rolled")]
        found = [self.packed_rollup(kind, part) for part in parts]
        return reduce(DataFrame.unionByName, [*found, self.loose_rollup(kind)])

    def loose_uncounted(self) -> DataFrame:
        """Records of the runs that neither a compaction has merged nor a rollup counts."""
        lines = self._loose_lines().join(self._loose_rolled(False), "run", "left_semi")
        return lines.where(F.col("outcome") == RECORD)

    def uncounted(self) -> DataFrame | None:
        """Records that no rollup counts, written before there were any; None if there are none."""
        parts = [part for part in self.line_parts(self.generation()) if not part.get("rolled")]
        found = [self.packed_lines([part]).where(F.col("outcome") == RECORD) for part in parts]
        if not self._loose_rolled(False).isEmpty():
            found.append(self.loose_uncounted())
        return reduce(DataFrame.unionByName, found) if found else None

    def rejects(self) -> DataFrame:
        return (
            self.lines()
            .where(F.col("outcome") == REJECT)
            .select("import_job_id", "source_type", "arrival", "raw", "error_code")
        )

    def issues_version(self) -> int:
        newest = self.runs().agg(F.max("issues_version")).first()[0]
        return 0 if newest is None else newest

    def issue_parts(self, version: int | None = None) -> list[int]:
        """For every bucket the version that last wrote it, as of ``version`` (the newest by default)."""
        runs = self.runs().orderBy(F.desc("issues_version"))
        if version is not None:
            runs = runs.where(F.col("issues_version") == version)
        row = runs.select("issue_parts").first()
        return list(row[0]) if row and row[0] else [0] * self.issue_buckets

    def issues(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """Issue snapshot, the newest published one by default; of some buckets only if they are given."""
        parts = self.issue_parts(version)
        chosen = range(len(parts)) if buckets is None else sorted(buckets)
        paths = [f"{self.base}/issues/version={parts[b]}/bucket={b}" for b in chosen if parts[b]]
        if not paths:
            return self.spark.createDataFrame([], schema.ISSUES)
        return self.spark.read.schema(schema.ISSUES).parquet(*paths)

    def issues_near(self, fingerprint: str) -> DataFrame:
        """The bucket of issues that holds a fingerprint, if any does."""
        n = len(self.issue_parts())
        row = self.spark.range(1).select(bucket_of(F.lit(fingerprint), n)).first()
        return self.issues(buckets=[row[0]])

    def transitions(self) -> DataFrame:
        return self._table("jobs", schema.JOBS)

    def progress(self) -> DataFrame:
        """Counts taken while runs were written."""
        if not self._exists(f"{self.base}/progress"):
            return self.spark.createDataFrame([], PROGRESS)
        files = self.spark.read.schema(PROGRESS).option("recursiveFileLookup", True)
        return files.option("pathGlobFilter", "*.json").json(f"{self.base}/progress")

    def jobs(self) -> DataFrame:
        """Current row of each job; a running one with the lines written so far."""
        rows = self.transitions()
        return ledger.latest(rows.unionByName(ledger.live(rows, self.progress())))

    def refused(self, run: str) -> DataFrame:
        """Actions of a run that no issue could take."""
        return self.spark.read.schema(REFUSED).parquet(f"{self.base}/refused/run={run}")

    # --- writing ---

    def write_lines(self, lines: DataFrame, run: str) -> None:
        """Write parsed lines of a run, good and bad, in one pass.

        No shuffle: log files are roughly in time order, so a split touches few
        days. Rows are sorted inside each task, which keeps the minimum and
        maximum of every row group narrow.
        """
        outcome = F.when(F.col("error_code").isNull(), RECORD).otherwise(REJECT)
        (
            lines.withColumn("outcome", outcome)
            .withColumn("event_date", F.to_date("timestamp"))
            .sortWithinPartitions(
                "outcome", "event_date", F.desc("timestamp"), F.desc("id")
            )
            .write.mode("overwrite")
            .partitionBy("outcome", "event_date")
            .parquet(f"{self.base}/lines/run={run}")
        )

    def write_rollups(self, run: str) -> None:
        """Count the written records of a run; only the columns of the keys are read."""
        records = self.run_lines(run).where(F.col("outcome") == RECORD)
        for kind in rollups.ROLLUPS:
            self.write_rollup(rollups.rolled(records, kind), kind, f"{self.base}/{kind}/run={run}")

    def write_rollup(self, rollup: DataFrame, kind: str, path: str) -> None:
        """Partitions of the advised size; a large day is split, small days share one."""
        order = [name for name in ("event_date", "minute", "fingerprint") if name in rollup.columns]
        (
            rollup.select(*rollups.ROLLUPS[kind].names)
            .hint("rebalance", F.col("event_date"))
            .sortWithinPartitions(*order)
            .write.mode("overwrite")
            .partitionBy("event_date")
            .parquet(path)
        )

    def write_fold(self, folded: DataFrame, run: str) -> DataFrame:
        """Keep the issues of one run alone, and read them back."""
        path = f"{self.base}/folds/run={run}"
        folded.select(*[f.name for f in FOLDED]).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(FOLDED).parquet(path)

    def touched(self, fingerprints: DataFrame, buckets: int) -> list[int]:
        """Buckets that the fingerprints fall into; at most ``buckets`` numbers."""
        chosen = fingerprints.select(bucket_of(F.col("fingerprint"), buckets).alias("b")).distinct()
        return sorted(r["b"] for r in chosen.collect())

    def write_issues(
        self, issues: DataFrame, version: int, parts: Sequence[int], touched: Iterable[int]
    ) -> list[int]:
        """Write the issues of the touched buckets, one file each; returns the new parts."""
        path = f"{self.base}/issues/version={version}"
        if touched:
            (
                issues.select(*[f.name for f in schema.ISSUES])
                .withColumn("bucket", bucket_of(F.col("fingerprint"), len(parts)))
                .repartition("bucket")
                .write.mode("overwrite")
                .partitionBy("bucket")
                .parquet(path)
            )
        # A bucket without issues, as of an unknown fingerprint, has no file.
        written = set(self._names(path)) if touched else set()
        return [version if f"bucket={b}" in written else known for b, known in enumerate(parts)]

    def write_refused(self, refused: DataFrame, run: str) -> None:
        refused.select(*[f.name for f in REFUSED]).write.mode("overwrite").parquet(
            f"{self.base}/refused/run={run}"
        )

    def append_jobs(self, rows: DataFrame) -> None:
        rows.select(*[f.name for f in schema.JOBS]).write.mode("append").parquet(
            f"{self.base}/jobs"
        )

    def write_progress(self, run: str, at: datetime, lines: int, tasks_done: int, tasks: int) -> None:
        """One count of a run that is being written. No job runs for it, so it waits for no task."""
        row = {"run": run, "at": at.isoformat(), "lines": lines, "tasks_done": tasks_done, "tasks": tasks}
        name = f"{int(at.timestamp() * 1000):016d}-{lines}.json"
        self.write_text(f"{self.base}/progress/run={run}/{name}", json.dumps(row))

    def publish(
        self,
        run: str,
        issues_version: int,
        issue_parts: Sequence[int],
        totals: DataFrame,
        at: datetime,
        failed: Sequence[str] = (),
        rolled: bool = False,
    ) -> None:
        """Make a run visible. ``totals`` holds its single row of counts, ``rolled`` tells of its rollups."""
        row = totals.select(
            F.lit(run).alias("run"),
            F.lit(issues_version).cast("bigint").alias("issues_version"),
            "processed_lines",
            "parse_errors",
            "first_event",
            "last_event",
            instant_lit(parse_instant(at)).alias("published_at"),
            F.array(*[F.lit(p) for p in issue_parts]).cast("array<bigint>").alias("issue_parts"),
            F.array(*[F.lit(f) for f in failed]).cast("array<string>").alias("failed"),
            F.lit(rolled).alias("rolled"),
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.base}/runs")


def rollup_name(kind: str, part: dict) -> str:
    """Folder of a merged part's rollup."""
    return part["name"].replace("lines-", f"{kind}-", 1)


def bucket_of(fingerprint: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(fingerprint), F.lit(buckets)).cast("int")
