"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import corpus  # noqa: E402
from checks.queries import QUERIES  # noqa: E402
from logloom.plans.ingest import ingest  # noqa: E402
from logloom.session import configure  # noqa: E402

HEADLINE = (
    "error_rate_minute",
    "error_rate_hour",
    "error_rate_day",
    "by_service",
    "top_issues",
    "spikes",
    "new_issues",
    "list_logs_page1",
    "list_logs_filtered",
    "list_issues",
    "issue_fold",
    "issue_merge",
    "issue_actions",
    "blast_radius",
    "detect_format",
    "expand_envelope",
    "parse_jsonlines",
    "parse_gcp",
    "parse_cloudwatch",
    "parse_errors",
    "fingerprints",
    "spans_rebuild_text",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    configure(spark)
    # One untimed query, so that the first figure is not that of starting up.
    QUERIES["by_service"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.monotonic()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - started, 3)

    folder = corpus.new_folder(spark)
    landing = corpus.write_landing(spark, sf_dir, f"{folder}/landing")
    started = time.monotonic()
    outcome = ingest(spark, f"{landing}/*", f"{folder}/store", now=corpus.OBSERVED_AT)
    seconds["ingest_files"] = round(time.monotonic() - started, 3)

    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "ingested_lines": outcome.processed_lines,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
