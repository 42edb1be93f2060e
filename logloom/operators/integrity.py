"""Checks that must find nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def records_without_issue(records: DataFrame, issues: DataFrame) -> DataFrame:
    """Fingerprints that no issue has, with the number of their records.

    Counted before the join, so that an issue with most records sends one row per task.
    """
    counted = records.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("records"))
    return counted.join(issues.select("fingerprint"), "fingerprint", "left_anti")


def records_without_job(records: DataFrame, jobs: DataFrame) -> DataFrame:
    """Job ids that the ledger lacks, with the number of their records."""
    counted = records.groupBy("import_job_id").agg(F.count(F.lit(1)).alias("records"))
    known = jobs.select(jobs["id"].alias("import_job_id"))
    return counted.join(known, "import_job_id", "left_anti")
