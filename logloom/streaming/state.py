"""Issues kept as keyed state of a stream: each batch touches the issues it holds and no others."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from logloom.operators import records
from logloom.session import configure

#: Parts of an issue's state: one that holds most of the lines is folded by so many tasks.
PARTS = 16

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIRST = "sample_message string, severity_number int, first_seen timestamp"
_STATE = f"event_count bigint, last_seen timestamp, {_FIRST}, place string, services string"
_CHANGED = f"fingerprint string, part int, {_STATE}"
_ARRIVAL = {"file": "string", "block": "bigint", "row": "bigint", "event": "int"}


class IssuePart(StatefulProcessor):
    """Occurrences of one part of an issue: counts, ends, the first one, services in order.

    ``place`` is the arrival of the first occurrence, ``services`` each service with the
    arrival of its first one; both are JSON, arrivals as lists.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("issue", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._state.get()
        count, last, sample, severity, first_seen, place, services = held or (0, None, None, None, None, None, "{}")
        place = None if place is None else json.loads(place)
        known = json.loads(services)
        for frame in rows:
            for row in frame.itertuples(index=False):
                at = [row.file, int(row.block), int(row.row), int(row.event)]
                seen = row.occurred_at.to_pydatetime()
                count += 1
                last = seen if last is None else max(last, seen)
                if place is None or at < place:
                    place, sample, first_seen = at, row.message, seen
                    severity = None if pd.isna(row.severity_number) else int(row.severity_number)
                if row.service_name is not None and (row.service_name not in known or at < known[row.service_name]):
                    known[row.service_name] = at
        state = (count, last, sample, severity, first_seen, json.dumps(place), json.dumps(known))
        self._state.update(state)
        names = [f.split()[0] for f in _CHANGED.split(", ")]
        frame = pd.DataFrame([(*key, *state)], columns=names)
        yield frame.astype({"severity_number": "Int32"})

    def close(self) -> None:
        pass


def start_issue_state(
    drafts: DataFrame, folder: str, checkpoint: str, *, parts: int = PARTS, every: str | None = None
) -> StreamingQuery:
    """Keep issues up to date from a stream of parsed lines (drafts), as any source's ``parse`` gives.

    The state of an issue lives in a state store under its fingerprint, dealt over
    ``parts`` by the place of the line; a batch reads and writes the keys it holds.
    What changed goes to ``folder``, a file set per batch, so a batch done again after
    a restart replaces its own. ``read_issues`` gives the issues. Without ``every`` it
    takes what is there and stops.
    """
    spark = configure(drafts.sparkSession)
    # State of single keys is kept on disk of the executors and in the checkpoint.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    # Neither job nor time of import enters an issue.
    lines = records.assemble(drafts, datetime(1970, 1, 1, tzinfo=timezone.utc), F.lit(""))
    found = records.occurrences(records.records(lines))
    rows = found.select(
        "fingerprint",
        F.pmod(F.xxhash64("arrival"), F.lit(parts)).cast("int").alias("part"),
        "message", "severity_number", "occurred_at", "service_name",
        *[F.col(f"arrival.{x}").alias(x) for x in _ARRIVAL],
    )
    changed = rows.groupBy("fingerprint", "part").transformWithStateInPandas(
        IssuePart(), _CHANGED, outputMode="Update", timeMode="None"
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer = changed.writeStream.outputMode("update").foreachBatch(keep)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Issues as of the last finished batch, in the columns that ``issues.fold`` gives."""
    configure(spark)
    rows = spark.read.schema(f"{_CHANGED}, batch bigint").parquet(folder)
    latest = rows.groupBy("fingerprint", "part").agg(F.max_by(F.struct(*rows.columns), "batch").alias("row"))

    def arrival(values: Column) -> Column:
        return F.struct(*[values[k].cast(kind).alias(x) for k, (x, kind) in enumerate(_ARRIVAL.items())])

    services = F.transform(
        F.map_entries(F.from_json("services", "map<string,array<string>>")),
        lambda entry: F.struct(arrival(entry["value"]).alias("arrival"), entry["key"].alias("name")),
    )
    place = arrival(F.from_json("place", "array<string>"))
    parts = latest.select("row.*").withColumn("place", place).withColumn("services", services)
    first = F.struct("sample_message", "severity_number", "first_seen")
    whole = parts.groupBy("fingerprint").agg(
        F.sum("event_count").alias("event_count"),
        F.max("last_seen").alias("last_seen"),
        F.min_by(first, "place").alias("first"),
        # At most ``parts`` rows with the services of each.
        F.array_sort(F.flatten(F.collect_list("services"))).alias("services"),
    )
    return whole.select(
        "fingerprint",
        "first.*",
        "last_seen",
        "event_count",
        F.array_distinct(F.col("services.name")).alias("affected_services"),
    )
