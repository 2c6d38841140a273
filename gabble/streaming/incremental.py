"""Incremental scoring as streams over landed parquet folders.

A run takes what has landed since the last one and ends (``availableNow``). Progress lives in the
checkpoint folder, results in append-only files, so a killed run continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gabble.operators.resume import SCORE_KEY

#: Parts within which copies of a key are dropped first.
_PARTS = 64

Score = Callable[[DataFrame], DataFrame]


def read_landed(spark: SparkSession, path: str, schema, files_per_batch: int | None = None
                ) -> DataFrame:
    """Stream of a folder's files; ``files_per_batch`` sets how much one commit covers."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def unique(stream: DataFrame, keys: Sequence[str] = SCORE_KEY, event_time: str | None = None,
           delay: str | None = None) -> DataFrame:
    """Each key once over all runs, from the state store.

    A streaming dedupe has no map-side step, so a flood of copies of one comment would all travel to
    the one task that holds its state. Copies are therefore dropped within parts first, by the task
    that read them; the second step sees a key once a part. Without a delay the state keeps every
    key ever seen; with one it forgets keys older than that.
    """
    parted = stream.withColumn("_part", F.spark_partition_id() % _PARTS)
    if event_time and delay:
        late = parted.withWatermark(event_time, delay)
        return (late.dropDuplicatesWithinWatermark([*keys, "_part"]).drop("_part")
                .dropDuplicatesWithinWatermark(list(keys)))
    return parted.dropDuplicates([*keys, "_part"]).drop("_part").dropDuplicates(list(keys))


def run_available(result: DataFrame, sink: str, checkpoint: str) -> None:
    """Process everything new and append it to a parquet folder, exactly once."""
    query = (
        result.writeStream.format("parquet").outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
