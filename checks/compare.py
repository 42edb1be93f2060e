"""Run registered queries against their SQL: ``python -m checks.compare [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    shaped = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(shaped, key=lambda row: [(value is None, str(value)) for value in row])


def spark_rows(frame: DataFrame) -> tuple[list[str], list[tuple]]:
    return sorted(frame.columns), rows_of(frame.columns, frame.collect())


def duck_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    return sorted(names), rows_of(names, result.fetchall())


def compare(spark: SparkSession, sf_dir: str, names: list[str]) -> list[str]:
    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    failed = []
    for name in names or list(QUERIES):
        started = time.monotonic()
        try:
            columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
            if name not in ORACLE:
                verdict = f"no SQL, {len(rows)} rows"
            else:
                expected_columns, expected = duck_rows(sf_dir, ORACLE[name])
                if columns != expected_columns:
                    verdict = f"COLUMNS {columns} / {expected_columns}"
                elif rows != expected:
                    pairs = [(a, b) for a, b in zip(rows, expected) if a != b][:2]
                    verdict = f"DIFFERS {len(rows)} / {len(expected)} rows, e.g. {pairs}"
                else:
                    verdict = f"ok, {len(rows)} rows"
        except Exception as error:  # noqa: BLE001
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        if verdict.split()[0] in ("COLUMNS", "DIFFERS", "ERROR"):
            failed.append(name)
        print(f"{name:24s} {time.monotonic() - started:6.2f}s  {verdict}", flush=True)
    return failed


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    failed = compare(spark, f"/root/testdata/sf{sf}", sys.argv[2:])
    print("failed:", failed or "none")
    spark.stop()


if __name__ == "__main__":
    main()
