"""Import jobs: transitions, latest state and projections."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from logloom import schema

MOST_IMPORTS = 50

# Order of the states a job passes through.
STEPS = {schema.PENDING: 0, schema.RUNNING: 1, schema.COMPLETED: 3, schema.FAILED: 3}


class JobNotFound(LookupError):
    """No import job has the given id."""


def transition(
    jobs: DataFrame, status: str, at: Column, progress: bool = False, **changes: Column
) -> DataFrame:
    """Next ledger row of every job. Rows are only ever added."""
    step = 2 if progress else STEPS[status]
    columns = dict(changes)
    columns["status"] = F.lit(status)
    columns["step"] = F.lit(step)
    columns["updated_at"] = at
    if status == schema.PENDING:
        columns["created_at"] = at
    if status in (schema.COMPLETED, schema.FAILED):
        columns["finished_at"] = at
    known = set(jobs.columns)
    return jobs.select(
        *[
            columns.get(field.name, F.col(field.name) if field.name in known else F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for field in schema.JOBS
        ]
    )


def latest(ledger: DataFrame) -> DataFrame:
    """Current row of each job."""
    whole = F.struct(*[field.name for field in schema.JOBS])
    # A failed job may be tried again under its name; nothing follows its completion.
    order = F.struct("step", F.col("status") == schema.COMPLETED, "updated_at")
    newest = ledger.groupBy("id").agg(
        F.max_by(whole, order).alias("job"),
        F.count(F.lit(1)).alias("transitions"),
    )
    return newest.select("job.*")


def live(ledger: DataFrame, counts: DataFrame) -> DataFrame:
    """Ledger rows of running jobs, one for each count taken while their run was written.

    ``counts`` holds ``run, at, lines``. The files of a run are written together: until
    its own lines are known, a file has its share of them by size. Counts from before
    a job was last opened belong to an attempt that failed.
    """
    opened = latest(ledger.where(F.col("step") == STEPS[schema.RUNNING]))
    sizes = opened.groupBy("run").agg(F.sum("size_bytes").alias("_all"))
    rows = opened.drop("processed_lines").join(sizes, "run").join(counts, "run").where("at >= updated_at")
    share = F.floor(F.col("lines") * F.col("size_bytes") / F.col("_all"))
    return transition(rows.withColumn("processed_lines", share), schema.RUNNING, F.col("at"), progress=True)


def list_imports(jobs: DataFrame) -> DataFrame:
    """Latest imports, at most 50."""
    return (
        jobs.select(
            "id",
            "filename",
            F.lower("status").alias("status"),
            "created_at",
            "total_lines",
            "processed_lines",
            "parse_errors",
        )
        .orderBy(F.desc("created_at"), "id")
        .limit(MOST_IMPORTS)
    )


def import_status(jobs: DataFrame) -> DataFrame:
    """Status of jobs with the result of finished ones."""
    done = (F.col("status") == schema.COMPLETED) & F.col("elapsed_ms").isNotNull()
    rate = F.when(F.col("elapsed_ms") <= 0, F.col("processed_lines")).otherwise(
        _half_up(F.col("processed_lines") / (F.col("elapsed_ms") / 1000.0))
    )
    return jobs.select(
        "id",
        "filename",
        F.lower("status").alias("status"),
        "source_type",
        "total_lines",
        F.coalesce("processed_lines", F.lit(0)).cast("bigint").alias("processed_lines"),
        F.coalesce("parse_errors", F.lit(0)).cast("bigint").alias("parse_errors"),
        "created_at",
        "finished_at",
        "error",
        F.when(done, F.col("processed_lines") - F.col("parse_errors")).alias(
            "ingested_records"
        ),
        F.when(done, F.col("elapsed_ms")).alias("elapsed_ms"),
        F.when(done, rate.cast("bigint")).alias("lines_per_second"),
    )


def get_import(jobs: DataFrame, job_id: str) -> Row:
    """Status of one job; the id must be a UUID and known."""
    try:
        key = str(uuid.UUID(job_id))
    except (ValueError, AttributeError, TypeError) as error:
        raise ValueError(f"import id must be a UUID: {job_id!r}") from error
    row = import_status(jobs.where(F.col("id") == key)).first()
    if row is None:
        raise JobNotFound(f"no import job {job_id}")
    return row


def progress(status: DataFrame) -> DataFrame:
    """Percent done (NULL while the total is unknown) and whether the job has ended."""
    percent = F.least(
        F.lit(100),
        _half_up(F.col("processed_lines") / F.col("total_lines") * 100),
    )
    return status.select(
        "id",
        "status",
        F.when(F.col("total_lines") > 0, percent.cast("int")).alias("percent"),
        F.lower("status").isin("completed", "failed").alias("terminal"),
    )


def _half_up(number: Column) -> Column:
    return F.floor(number + 0.5)
