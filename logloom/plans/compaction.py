"""Merge the many small files that imports leave into few large ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom import schema
from logloom.operators import rollups
from logloom.plans.store import RECORD, RUNS, Store, rollup_name


def compact(store: Store) -> int:
    """Merge the lines, run rows and ledger rows written since the last time; returns the generation.

    Lines of the new runs become one part, sorted by day. Parts that are not larger
    than twice what is merged join in, so that a line is rewritten a number of times
    that grows with the logarithm of the store, and as many parts exist. Nothing is
    deleted: a reader goes on with the files it has found, and the new generation
    counts from the moment its manifest is there. A compaction that died before is
    done again under the same number. Without new runs nothing happens.
    """
    spark, before = store.spark, store.generation()
    runs, jobs = store.loose("runs", RUNS, before), store.loose("jobs", schema.JOBS, before)
    names = [r["run"] for r in runs.select("run").collect()]
    if not names:
        return before
    now = before + 1
    folder = store.generation_path(now)
    rows = runs.agg(F.sum("processed_lines")).first()[0] or 0
    parts = store.line_parts(before)
    joining: list[dict] = []
    while parts and parts[-1]["rows"] <= 2 * rows:
        joining.append(parts.pop())
        rows += joining[-1]["rows"]
    if rows:
        new = store._loose_lines().where(F.col("run").isin(names))
        merged = reduce(DataFrame.unionByName, [new, *(store.packed_lines([part]) for part in joining)])
        part = {"name": f"lines-{now}", "rows": rows, "rolled": True}
        (
            # Partitions of the advised size; a large day is split, small days share one.
            merged.hint("rebalance", F.col("outcome"), F.col("event_date"))
            .sortWithinPartitions("outcome", "event_date", F.desc("timestamp"), F.desc("id"))
            .write.mode("overwrite")
            .partitionBy("outcome", "event_date")
            .parquet(f"{store.base}/packed/{part['name']}")
        )
        for kind in rollups.ROLLUPS:
            whole = _counts(store, kind, joining)
            store.write_rollup(whole, kind, f"{store.base}/rolled/{rollup_name(kind, part)}")
        parts.append(part)
    for name, frame, columns in (("runs", runs, RUNS), ("jobs", jobs, schema.JOBS)):
        known = frame.drop("_file")
        if before:
            old = spark.read.schema(columns).parquet(f"{store.generation_path(before)}/{name}")
            known = old.unionByName(known)
        known.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")
    sources = runs.select("_file").unionByName(jobs.select("_file")).distinct()
    if before:
        sources = spark.read.schema("_file string").parquet(f"{store.generation_path(before)}/sources").unionByName(sources)
    sources.coalesce(1).write.mode("overwrite").parquet(f"{folder}/sources")
    store.publish_generation(now, parts)
    return now


def _counts(store: Store, kind: str, joining: list[dict]) -> DataFrame:
    """Rollup of the runs since the last time and of the parts that join them.

    Runs and parts of a store older than its rollups are counted here, from their lines.
    """
    found = [store.loose_rollup(kind), rollups.rolled(store.loose_uncounted(), kind)]
    for part in joining:
        if part.get("rolled"):
            found.append(store.packed_rollup(kind, part))
        else:
            records = store.packed_lines([part]).where(F.col("outcome") == RECORD)
            found.append(rollups.rolled(records, kind))
    return rollups.added(found, kind)


def vacuum(store: Store) -> int:
    """Delete what the newest generation and the newest issues no longer need; returns the number of paths.

    Readers of older generations end with it, so it is run when they are done. Lines
    of runs that never were published stay, as they may be retried.
    """
    spark, generation = store.spark, store.generation()
    gone: list[str] = []
    if generation:
        folder = store.generation_path(generation)
        gone += [r["_file"] for r in spark.read.schema("_file string").parquet(f"{folder}/sources").collect()]
        merged = {r["run"] for r in spark.read.schema(RUNS).parquet(f"{folder}/runs").select("run").collect()}
        for table in ("lines", "folds", "progress", *rollups.ROLLUPS):
            found = store._names(f"{store.base}/{table}")
            gone += [f"{store.base}/{table}/{x}" for x in found if x.removeprefix("run=") in merged]
        parts_now = store.line_parts(generation)
        kept = {f"generation={generation}", *(part["name"] for part in parts_now)}
        counted = {rollup_name(kind, part) for part in parts_now for kind in rollups.ROLLUPS}
        gone += [f"{store.base}/packed/{x}" for x in store._names(f"{store.base}/packed") if x not in kept]
        gone += [f"{store.base}/rolled/{x}" for x in store._names(f"{store.base}/rolled") if x not in counted]
    parts = store.issue_parts()
    newest = store.issues_version()
    for name in store._names(f"{store.base}/issues"):
        version = name.removeprefix("version=")
        if not version.isdigit() or int(version) > newest:
            continue
        for bucket in store._names(f"{store.base}/issues/{name}"):
            number = bucket.removeprefix("bucket=")
            if number.isdigit() and parts[int(number)] != int(version):
                gone.append(f"{store.base}/issues/{name}/{bucket}")
    for path in gone:
        store.delete(path)
    return len(gone)
