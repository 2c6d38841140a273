"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: SQL settings the engine expects. All of them can be changed at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long texts travel to Python in small batches, so that a worker's memory stays low.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
    # Rank-and-cut inside the map tasks for any n; the cut itself keeps no rows in memory.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000000",
    # A JSON object with a repeated member keeps the last value instead of being unreadable.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # An empty text where an object should stand means that there is none, as in a comment without replies.
    "spark.sql.legacy.json.allowEmptyString.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

_SCRATCH_KEY = "spark.checkpoint.dir"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the cluster's shared ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it then gets a temporary folder, because
    driver and executors are the same machine there.
    """
    base = spark.conf.get(_SCRATCH_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SCRATCH_KEY} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gabble-")
        spark.conf.set(_SCRATCH_KEY, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several steps read to the shared folder and read it back.

    Cuts the lineage for good: a lost executor cannot make Spark repeat the work above. The shuffle files of
    that work are dropped as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
