"""Line scans, envelope expansion, head samples and metering."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logloom.functions import jsontext
from logloom.functions.text import WHITESPACE, is_blank
from logloom.session import configure

SAMPLE_SIZE = 20


def literal(path: str) -> str:
    """A listed path as the reader takes it: signs of patterns stand for themselves."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def with_arrival(scan: DataFrame) -> DataFrame:
    """Text scan to ``arrival, value``; must sit directly on the scan."""
    return scan.select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            F.lit(0).alias("event"),
        ).alias("arrival"),
        F.col("value"),
    )


def scan_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files; CR, LF and CRLF end a line. A missing path raises."""
    return with_arrival(spark.read.text(paths))


def expand_envelopes(lines: DataFrame) -> DataFrame:
    """One line per event of a CloudWatch envelope; every other line as it is."""
    # Only lines that name the three members are worth parsing.
    candidate = (
        F.contains(F.col("value"), F.lit("logGroup"))
        & F.contains(F.col("value"), F.lit("logStream"))
        & F.contains(F.col("value"), F.lit("logEvents"))
        & jsontext.starts_object(F.col("value"))
    ) | F.contains(F.col("value"), F.lit("\\u"))
    doc = F.when(candidate, jsontext.parse_strict(F.col("value")))
    group, stream = (
        F.try_variant_get(F.col("_doc"), f"$.{key}", "variant") for key in ("logGroup", "logStream")
    )
    events = F.try_variant_get(F.col("_doc"), "$.logEvents", "array<variant>")
    envelope = F.create_map(
        F.lit("logGroup"), F.col("_group"), F.lit("logStream"), F.col("_stream")
    )

    def event_line(event: Column) -> Column:
        own = F.coalesce(
            jsontext.entries_of(event), F.create_map(F.lit("message"), event)
        )
        return jsontext.short_numbers(F.to_json(jsontext.overlay(envelope, own)))

    # The finished lines of an envelope are one array, and a line that is no envelope
    # is an array of itself: nothing but the arrival passes beside what is exploded.
    place = [F.col(f"arrival.{x}").alias(f"_{x}") for x in ("file", "block", "row")]
    staged = lines.select(*place, "value", doc.alias("_doc")).select(
        "_file",
        "_block",
        "_row",
        "value",
        group.alias("_group"),
        stream.alias("_stream"),
        F.when(
            jsontext.is_string(group) & jsontext.is_string(stream), events
        ).alias("_events"),
    )
    whole = staged.select(
        "_file",
        "_block",
        "_row",
        F.when(F.col("_events").isNotNull(), F.transform("_events", event_line))
        .otherwise(F.array("value"))
        .alias("_lines"),
    )
    exploded = whole.select(
        "_file", "_block", "_row", F.posexplode("_lines").alias("_position", "value")
    )
    arrival = F.struct(
        F.col("_file").alias("file"),
        F.col("_block").alias("block"),
        F.col("_row").alias("row"),
        F.col("_position").alias("event"),
    )
    return exploded.select(arrival.alias("arrival"), "value")


def head_sample(lines: DataFrame, size: int = SAMPLE_SIZE) -> DataFrame:
    """First non-blank lines of every file, in order of arrival."""
    order = W.partitionBy("arrival.file").orderBy("arrival")
    return (
        lines.where(~is_blank(F.col("value")))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= size)
        .drop("_rank")
    )


# Batches of 200 lines.
_READ_OFF = 100
_EMPTY_ENVELOPE = r'"logEvents"\s*:\s*\[\s*\]'


def _take_heads(size: int):
    """Per split: keep the leading lines of the file and stop reading."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = size
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if batch.column("block")[0].as_py() != 0:
                return
            # Lines that may vanish (blank, or an envelope without events) do not
            # count; they are kept because only the plan decides about them.
            value = batch.column("value")
            counts = pc.and_(
                pc.not_equal(pc.utf8_trim(value, characters=WHITESPACE), ""),
                pc.invert(pc.match_substring_regex(value, _EMPTY_ENVELOPE)),
            )
            reached = pc.cumulative_sum(pc.cast(counts, pa.int64()))
            enough = pc.index(reached, pa.scalar(left, pa.int64())).as_py()
            if enough >= 0:
                yield batch.slice(0, enough + 1)
                # The rest of a short file is read off, which lets the worker process
                # be used again; a long file is left where it is.
                deque(islice(batches, _READ_OFF), maxlen=0)
                return
            left -= reached[-1].as_py()
            yield batch

    return take


def read_heads(spark: SparkSession, paths: str | list[str], size: int = SAMPLE_SIZE) -> DataFrame:
    """Leading lines of every file, without reading the files to the end.

    A session of its own packs one file into one scan task, so that a task may
    stop as soon as it has its lines.
    """
    session = configure(spark.newSession())
    whole_file = str(1 << 40)
    session.conf.set("spark.sql.files.maxPartitionBytes", whole_file)
    session.conf.set("spark.sql.files.openCostInBytes", whole_file)
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    scan = scan_lines(session, paths).select("arrival.*", "value")
    heads = scan.mapInArrow(
        _take_heads(size), "file string, block bigint, row bigint, event int, value string"
    )
    return heads.select(F.struct("file", "block", "row", "event").alias("arrival"), "value")


def meter(lines: DataFrame, spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines and bytes per input file; an empty file counts zero lines."""
    counted = lines.groupBy(F.col("arrival.file").alias("file")).agg(
        F.count(F.lit(1)).alias("total_lines")
    )
    return file_sizes(spark, paths).join(counted, "file", "left").select(
        "file",
        "size_bytes",
        F.coalesce("total_lines", F.lit(0)).cast("bigint").alias("total_lines"),
    )


def file_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Path and size of every input file, from the listing alone."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size_bytes"),
    )
