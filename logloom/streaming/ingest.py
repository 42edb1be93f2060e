"""Files that arrive over time, imported batch by batch into the same store."""

from __future__ import annotations

import time
from collections.abc import Sequence
from datetime import datetime, timedelta, timezone
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.functions.times import parse_instant
from logloom.operators import records
from logloom.plans.ingest import close_jobs, commit_run, file_name, ingest, job_id
from logloom.plans.store import Store
from logloom.session import configure
from logloom.sources import lines as line_ops
from logloom.sources import registry
from logloom.sources.base import LogSource


def _parse_batch(
    lines: DataFrame,
    source_type: str | None,
    sources: Sequence[LogSource],
    fallback: LogSource,
) -> DataFrame:
    """Drafts of one batch; formats are detected per file unless one is forced."""
    if source_type is not None:
        return registry.parse_as(lines, source_type, sources)
    found = registry.detect(lines, sources, fallback).select("file", "source_type").collect()
    by_type: dict[str, list[str]] = {}
    for row in found:
        by_type.setdefault(row["source_type"], []).append(row["file"])
    by_type.setdefault(fallback.source_type, [])
    special = [f for name, files in by_type.items() if name != fallback.source_type for f in files]
    file = F.col("arrival.file")
    return registry.route(
        {
            name: lines.where(
                ~file.isin(special) if name == fallback.source_type else file.isin(files)
            )
            for name, files in by_type.items()
        },
        sources,
    )


def import_batch(
    batch: DataFrame,
    batch_id: int,
    base: str,
    *,
    name: str = "stream",
    source_type: str | None = None,
    now: datetime | None = None,
    sources: Sequence[LogSource] = registry.SOURCES,
    fallback: LogSource = registry.FALLBACK,
) -> None:
    """Import one batch of ``value, file, block`` rows of any stream.

    For streams that are not made of files, such as a message queue, where ``file``
    names the channel a line came from. Doing a batch again after a restart
    changes nothing.
    """
    spark = configure(batch.sparkSession)
    run = f"{name}-{batch_id}"
    store = Store(spark, base)
    now = parse_instant(now or datetime.now(timezone.utc))
    if store.is_published(run):
        # The batch may have ended between its publication and the closing of its jobs.
        _close_batch(store, run, source_type, now, None)
        return
    started = time.monotonic()
    lines = line_ops.expand_envelopes(
        batch.select(
            F.struct(
                "file", "block", F.monotonically_increasing_id().alias("row"),
                F.lit(0).alias("event"),
            ).alias("arrival"),
            "value",
        )
    )
    drafts = _parse_batch(lines, source_type, sources, fallback)
    whole = records.assemble(drafts, now, job_id(run, F.col("arrival.file")))
    store.write_lines(whole, run)
    commit_run(store, run, now)
    _close_batch(store, run, source_type, now, int((time.monotonic() - started) * 1000))


def _close_batch(
    store: Store, run: str, source_type: str | None, now: datetime, elapsed: int | None
) -> None:
    """One job per channel of the batch, opened and closed with it."""
    files = store.run_lines(run).select(
        F.col("import_job_id").alias("id"), F.col("arrival.file").alias("file")
    ).distinct()
    opened = files.select(
        "id",
        F.lit(run).alias("run"),
        file_name(F.col("file")).alias("filename"),
        F.col("file").alias("storage_key"),
        F.lit(source_type).alias("source_type"),
    )
    close_jobs(store, run, opened, now, now + timedelta(milliseconds=elapsed or 0), elapsed)


def read_stream(
    spark: SparkSession, landing: str, max_files_per_batch: int | None = None
) -> DataFrame:
    """Lines of arriving files. The batch size changes no result."""
    reader = spark.readStream
    if max_files_per_batch is not None:
        if max_files_per_batch < 1:
            raise ValueError("max_files_per_batch must be at least 1")
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    return reader.text(landing).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def start_import(
    spark: SparkSession,
    landing: str,
    base: str,
    checkpoint: str,
    *,
    name: str = "stream",
    source_type: str | None = None,
    max_files_per_batch: int | None = None,
    every: str | None = None,
    now: datetime | None = None,
    sources: Sequence[LogSource] = registry.SOURCES,
    fallback: LogSource = registry.FALLBACK,
) -> StreamingQuery:
    """Start the import: all files present and then stop, or ``every`` interval for good."""
    configure(spark)
    registry.check_source_type(source_type, sources)
    lines = read_stream(spark, landing, max_files_per_batch)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # The batch says which files are new; they are then imported like any other
        # files: heads for the format, one scan by the parser of that format.
        files = [
            line_ops.literal(unquote(row["file"]))
            for row in batch.select("file").distinct().collect()
        ]
        if files:
            ingest(
                batch.sparkSession,
                files,
                base,
                source_type=source_type,
                run=f"{name}-{batch_id}",
                now=now,
                sources=sources,
                fallback=fallback,
            )

    # Counted on the fly; listeners see the figure while the query runs.
    observed = lines.observe("import_progress", F.count(F.lit(1)).alias("lines"))
    writer = observed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()


def start_lines(
    lines: DataFrame,
    base: str,
    checkpoint: str,
    *,
    name: str = "stream",
    source_type: str | None = None,
    every: str | None = None,
    now: datetime | None = None,
    sources: Sequence[LogSource] = registry.SOURCES,
    fallback: LogSource = registry.FALLBACK,
) -> StreamingQuery:
    """Start the import of a stream of ``value, file, block`` rows, such as a message queue's.

    ``file`` names the channel that a line came from. Without ``every`` it takes what
    is there and stops.
    """
    configure(lines.sparkSession)
    registry.check_source_type(source_type, sources)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            import_batch(
                batch,
                batch_id,
                base,
                name=name,
                source_type=source_type,
                now=now,
                sources=sources,
                fallback=fallback,
            )

    writer = lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()
