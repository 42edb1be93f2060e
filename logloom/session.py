"""Session settings the library's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime SQL settings; all of them may be set on a running session.
SETTINGS = {
    # Buckets and zone-less instants are UTC.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value instead of making the line unreadable.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Overlaying two maps keeps the right-hand value.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Issue folding keeps one sample per key in a hash table. The default of 128
    # keys per task would push every task into a full sort of its rows.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
    # A parser is one wide projection. Fused into a single Java method it would be
    # too long for the JVM to compile; past this size Spark splits it up.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, default: str | None = None) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or default
    if folder is None:
        raise ValueError("spark.checkpoint.dir is not set and no shared folder was given")
    return folder
