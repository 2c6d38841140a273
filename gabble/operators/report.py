"""Counts, matrices, rates and funnels over collected and scored comments.

Every report is one aggregation with few groups. Partial aggregates run in the map tasks, so a
dominant person, label or subreddit costs no more than a rare one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the widest matrix.
MAX_LABELS = 1_000


def count_by(df: DataFrame, *keys: str, by_key: bool = False) -> DataFrame:
    """Rows per key, largest first or in key order."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.orderBy(*keys) if by_key else counts.orderBy(F.desc("n"), *keys)


def label_counts(df: DataFrame, label: str, *, with_null: bool = False) -> DataFrame:
    """Rows per label, largest first; unlabelled rows only on request."""
    rows = df if with_null else df.filter(F.col(label).isNotNull())
    return count_by(rows, label)


def label_counts_by(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Long form: rows per key and label, unlabelled rows left out."""
    return (
        df.filter(F.col(label).isNotNull())
        .groupBy(*keys, label)
        .agg(F.count("*").alias("n"))
    )


def found_labels(df: DataFrame, label: str) -> list[str]:
    """All labels of a column in order, at most :data:`MAX_LABELS`."""
    rows = df.filter(F.col(label).isNotNull()).select(label).distinct().limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"{label} has over {MAX_LABELS} values; it is no label")
    return sorted(r[0] for r in rows)


def labelled(df: DataFrame, label: str, labels: Sequence[str], others: str = "fail") -> DataFrame:
    """Rows with a label. One that is not in ``labels`` stops the job, or with ``others="drop"`` goes."""
    inside = F.col(label).isin(*labels)
    if others == "fail":
        inside = F.when(inside, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit(f"{label} outside the given list: "), F.col(label))).cast("boolean"))
    elif others != "drop":
        raise ValueError(f"others must be fail or drop, not {others!r}")
    return df.filter(F.col(label).isNotNull()).filter(inside)


def label_matrix(df: DataFrame, key: str, label: str, labels: Sequence[str] | None = None,
                 others: str = "fail") -> DataFrame:
    """Wide form: one row per key, one count column per label, 0 for absent pairs.

    Without ``labels`` every label of the data gets a column.
    """
    labels = found_labels(df, label) if labels is None else list(labels)
    if not labels:
        return df.filter(F.lit(False)).select(key)
    return (
        labelled(df, label, labels, others)
        .groupBy(key)
        .agg(*[F.count_if(F.col(label) == name).alias(name) for name in labels])
    )


def negative_rate(df: DataFrame, label: str = "sentiment", negative: str = "negative",
                  *, exclude_unknown: bool = False) -> DataFrame:
    """Per person: labelled rows, negative rows, percentage to one decimal.

    Failed rows labelled ``unknown`` count as labelled unless excluded.
    """
    counted = F.col(label)
    if exclude_unknown:
        counted = F.when(counted != "unknown", counted)
    return (
        df.groupBy("persoon", "gender")
        .agg(F.count(counted).alias("totaal"),
             F.count_if(counted == negative).alias("negatief"))
        .withColumn("pct_negatief", F.when(
            F.col("totaal") > 0, F.round(100.0 * F.col("negatief") / F.col("totaal"), 1)))
        .orderBy("gender", "persoon")
    )


def rate_by(df: DataFrame, keys: Sequence[str] = (), flag: str = "negative") -> DataFrame:
    """Flagged rows over all rows, unscored ones included, per key or overall."""
    return (
        df.groupBy(*keys)
        .agg(F.count_if(F.col(flag)).alias("n_negative"), F.count("*").alias("n_rows"))
        .withColumn("pct_negative", F.when(
            F.col("n_rows") > 0, F.round(100.0 * F.col("n_negative") / F.col("n_rows"), 6)))
    )


def flagged_by(df: DataFrame, key: str = "gender", flag: str = "negative") -> DataFrame:
    """Rows with a true flag per key."""
    return count_by(df.filter(F.col(flag)), key)


def filter_flags(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows on which all nullable flags are true."""
    return df.filter(reduce(Column.__and__, [F.col(f) for f in flags]))


def filter_label(df: DataFrame, label: str, value: str) -> DataFrame:
    """Rows with one label."""
    return df.filter(F.col(label) == value)


def funnel(df: DataFrame, keep: Column) -> DataFrame:
    """Total, kept and removed rows of a filter; null counts as removed."""
    return df.agg(F.count("*").alias("total"), F.count_if(keep).alias("relevant")).withColumn(
        "filtered_out", F.col("total") - F.col("relevant"))


def overview(entities: DataFrame, threads: DataFrame, comments: DataFrame) -> DataFrame:
    """Per person: gender, kept comments, and threads of which nothing was kept.

    ``threads`` and ``comments`` have ``persoon`` and ``thread_id``; persons without either still
    get a row.
    """
    per_thread = comments.groupBy("persoon", "thread_id").agg(F.count("*").alias("n"))
    per_person = (
        threads.select("persoon", "thread_id").distinct()
        .join(per_thread, ["persoon", "thread_id"], "left")
        .groupBy("persoon")
        .agg(F.sum(F.coalesce("n", F.lit(0))).alias("comments"),
             F.count_if(F.col("n").isNull()).alias("threads_empty"))
    )
    return (
        entities.select("persoon", "gender")
        .join(per_person, "persoon", "left")
        .na.fill(0, ["comments", "threads_empty"])
    )


def tier_report(entities: DataFrame, threads: DataFrame, comments: DataFrame) -> DataFrame:
    """Per person of ``entities``: comments kept from tier 1 and tier 2 threads, and threads with
    none kept."""
    per_thread = comments.groupBy("persoon", "thread_id").agg(F.count("*").alias("n"))
    kept = F.coalesce(F.col("n"), F.lit(0))
    per_person = (
        threads.select("persoon", "thread_id", "tier").distinct()
        .join(per_thread, ["persoon", "thread_id"], "left")
        .groupBy("persoon")
        .agg(F.sum(F.when(F.col("tier") == 1, kept).otherwise(0)).alias("tier1_comments"),
             F.sum(F.when(F.col("tier") == 2, kept).otherwise(0)).alias("tier2_comments"),
             F.count_if(F.col("n").isNull()).alias("threads_empty"))
    )
    return _every_person(entities, per_person)


def _every_person(entities: DataFrame, counts: DataFrame) -> DataFrame:
    """The counts of all persons, 0 where there are none."""
    return entities.select("persoon").join(counts, "persoon", "left").na.fill(
        0, [c for c in counts.columns if c != "persoon"])


def tier_sizes(entities: DataFrame, threads: DataFrame) -> DataFrame:
    """Distinct threads per person of ``entities``: tier 1, tier 2 and all."""
    sizes = (
        threads.select("persoon", "tier", "thread_id").distinct()
        .groupBy("persoon")
        .agg(F.count_if(F.col("tier") == 1).alias("tier1_threads"),
             F.count_if(F.col("tier") == 2).alias("tier2_threads"),
             F.count("*").alias("all_threads"))
    )
    return _every_person(entities, sizes)
