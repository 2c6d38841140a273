"""Join-back of scores and resuming work that was interrupted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gabble.operators.select import last_per_key
from gabble.session import written

#: A comment can belong to two persons, so every score is keyed by both.
SCORE_KEY = ("comment_id", "persoon")


def remaining(df: DataFrame, done: DataFrame, keys: Sequence[str] = SCORE_KEY) -> DataFrame:
    """Rows without an earlier result."""
    return df.join(done.select(*keys), list(keys), "left_anti")


def scored(df: DataFrame, scores: DataFrame, keys: Sequence[str] = SCORE_KEY) -> DataFrame:
    """Rows that have a result in this batch."""
    return df.join(scores.select(*keys), list(keys), "left_semi")


def attach_scores(df: DataFrame, scores: DataFrame, keys: Sequence[str] = SCORE_KEY) -> DataFrame:
    """Left join of result columns; rows without a result keep nulls."""
    return df.join(scores, list(keys), "left")


def attach_latest(df: DataFrame, scores: DataFrame, order: str,
                  keys: Sequence[str] = SCORE_KEY) -> DataFrame:
    """Like :func:`attach_scores` after keeping each key's last result."""
    return attach_scores(df, last_per_key(scores, keys, order).drop(order), keys)


def unlabelled(df: DataFrame, saved: DataFrame, label: str,
               keys: Sequence[str] = SCORE_KEY) -> DataFrame:
    """Rows whose saved label is missing, by key: an absent row and a null label both count."""
    labelled = saved.filter(F.col(label).isNotNull())
    return remaining(df, labelled, keys)


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """Rows numbered from 0 on in the given order, which must be unique for the numbers to be so.

    The rows are sorted in ranges that stay where they are; only the number of rows of each range, one row a task,
    is added up. No task sees more than its range.
    """
    laid = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(
        {"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "numbered")
    shifts, total = [], 0
    for part, first, n in sorted(laid.groupBy("_part").agg(F.min("_row"), F.count(F.lit(1))).collect()):
        shifts.append((part, total - first))
        total += n
    shift = df.sparkSession.createDataFrame(shifts, "_part int, _shift bigint")
    return (laid.join(F.broadcast(shift), "_part").withColumn(name, F.col("_row") + F.col("_shift"))
            .drop("_part", "_row", "_shift"))


def attach_by_position(df: DataFrame, saved: DataFrame, label: str, order: Sequence[str], saved_order: Sequence[str]) -> DataFrame:
    """``df`` with ``position``, the saved ``label`` of the row at the same position, and ``to_do``.

    For saved columns that carry no key. Work went from the top, so as many rows as are filled are done and ``to_do``
    marks the others; a shorter saved table leaves nulls, rows beyond the end of ``df`` are ignored.
    """
    rows = numbered(df, *order)
    labels = numbered(saved.select(*dict.fromkeys([*saved_order, label])), *saved_order).select("position", label)
    joined = written(rows.join(labels, "position", "left"), "attached")
    filled = joined.agg(F.count(label)).first()[0]
    return joined.withColumn("to_do", F.col("position") >= filled)


def append_results(done: DataFrame, new: DataFrame) -> DataFrame:
    """Earlier and new results as one table; columns only one side has are null on the other."""
    return done.unionByName(new, allowMissingColumns=True)
