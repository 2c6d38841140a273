"""Selection: first and last per key, budgets, caps, samples, row ranges, look-back periods."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType
from pyspark.sql.window import Window

from gabble import catalog
from gabble.session import written
from gabble.sources.landed import read_state

_PARTS = 64
_SLICE_BUCKETS = 256
_SLICE_ROWS = 10_000


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
                  *, few_groups: bool = False) -> DataFrame:
    """The first ``n`` rows of each group in the given (total) order.

    Each map task already reduces every group to ``n`` rows before the shuffle. With few groups
    those survivors of all map tasks would still meet in few tasks, so they are ranked in parts
    first. A map task writes to one part only, which keeps its survivors at ``n`` per group, and the
    task that ranks a whole group sees at most ``n`` rows per part.
    """
    if few_groups:
        parted = df.withColumn("_part", F.spark_partition_id() % _PARTS)
        df = top_per_group(parted, [*group, "_part"], order, n).drop("_part")
    window = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Dedupe, keeping the first row per key. Null keys count as equal.

    Rows are dealt out and sorted by a 256-bit digest of the key, so that no long text is compared.
    """
    return top_per_group(df.withColumn("_key", key_digest(keys)), ["_key"], order, 1).drop("_key")


def key_digest(keys: Sequence[str]) -> Column:
    """32 bytes that stand for the values of a key; null is a value, lengths keep the parts apart."""
    parts = [F.col(k).cast("string") for k in keys]
    told = [F.coalesce(F.concat(F.octet_length(p), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.unhex(F.sha2(F.concat(*told), 256))


def last_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Dedupe, keeping the row with the highest order value per key; ties by the other columns."""
    return top_per_group(df, keys, [F.col(order).desc(), *_ties(df, [*keys, order])], 1)


def _ties(df: DataFrame, used: Sequence[str]) -> list[Column]:
    """The other columns that have an order, to make the order of rows total."""
    ordered = [f.name for f in df.schema if f.name not in used
               and not any(kind in f.dataType.simpleString() for kind in ("map<", "variant", "interval"))]
    return [F.col(f"`{name}`") for name in ordered]


def unify_threads(found: DataFrame) -> DataFrame:
    """One row per person and thread from several searches; the latest search wins.

    Of a thread that one search lists twice, the later ``position`` wins if there is such a column,
    then the order of the other columns decides, so the winner does not depend on the partitioning.
    Threads without an id are skipped.
    """
    used = ["persoon", "thread_id", "query_index"]
    order = [F.col("query_index").desc()]
    if "position" in found.columns:
        used, order = [*used, "position"], [*order, F.col("position").desc()]
    return top_per_group(
        found.filter(F.col("thread_id").isNotNull() & (F.col("thread_id") != "")),
        ["persoon", "thread_id"], [*order, *_ties(found, used)], 1)


def dedupe_by_priority(comments: DataFrame) -> DataFrame:
    """One row per person and comment: tier 1 first, then the higher thread score."""
    return top_per_group(
        comments, ["persoon", "comment_id"],
        [F.col("tier"), F.col("thread_score").desc(), F.col("thread_id"),
         *_ties(comments, ["persoon", "comment_id", "tier", "thread_score", "thread_id"])], 1)


def thread_budget(threads: DataFrame, limit: int | None = catalog.MAX_THREADS_PER_PERSON) -> DataFrame:
    """Per person the best ``limit`` threads by score; tier 1 fills the budget before tier 2.

    ``None`` keeps all threads.
    """
    if limit is None:
        return threads
    order = [F.col("tier"), F.col("score").desc(), F.col("thread_id")]
    return top_per_group(threads, ["persoon"], order, limit, few_groups=True)


def cap_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int
                  ) -> DataFrame:
    """At most ``n`` rows per search query or thread, as the collecting site returns them."""
    return top_per_group(df, group, order, n, few_groups=True)


def sample_per_group(df: DataFrame, group: Sequence[str], n: int, key: str = "comment_id",
                     seed: int = catalog.SAMPLE_SEED) -> DataFrame:
    """Stratified sample of min(n, group size) rows, the same rows on every run.

    Rows are ranked by a hash of seed and key, so the draw does not depend on the partitioning.
    """
    rank = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return (
        df.withColumn("_draw", rank)
        .transform(top_per_group, group, [F.col("_draw"), F.col(key)], n, few_groups=True)
        .drop("_draw")
    )


def saved_sample(df: DataFrame, path: str, group: Sequence[str], n: int, key: str = "comment_id",
                 seed: int = catalog.SAMPLE_SEED) -> DataFrame:
    """The sample saved at ``path``; the first call draws and saves it."""
    saved = read_state(df.sparkSession, path, df.schema)
    if saved.isEmpty():
        sample_per_group(df, group, n, key, seed).write.mode("overwrite").parquet(path)
        saved = read_state(df.sparkSession, path, df.schema)
    return saved


def label_sheet(df: DataFrame, n: int = catalog.LABEL_SAMPLE_SIZE,
                slots: Iterable[str] = ("manual_label", "model_deberta", "model_gpt",
                                        "model_claude")) -> DataFrame:
    """Per-person sample of commented rows with empty columns to fill in by hand or by model."""
    return (
        df.filter(F.col("comment").isNotNull())
        .select("comment_id", "persoon", "gender", "subreddit", "comment")
        .transform(sample_per_group, ["persoon"], n)
        .drop("comment_id")
        .withColumns({slot: F.lit("") for slot in slots})
    )


def slice_rows(df: DataFrame, start: int | None, stop: int | None,
               order: str = "ingest_order") -> DataFrame:
    """Rows ``start <= position < stop`` in the order of a unique numeric column.

    The order column alone is written once; the column's values at the two positions are looked up
    there and bound the rows. The rows themselves are neither sorted nor shuffled.
    """
    if not start and stop is None:
        return df
    keys = written(df.select(order), "slice")
    first = _value_at(keys, order, start) if start else None
    if start and first is None or stop is not None and stop <= (start or 0):
        return df.limit(0)
    beyond = None if stop is None else _value_at(keys, order, stop)
    if first is not None:
        df = df.filter(F.col(order) >= F.lit(first))
    if beyond is not None:
        df = df.filter(F.col(order) < F.lit(beyond))
    return df


def _value_at(keys: DataFrame, order: str, position: int):
    """The order value at a position, or ``None`` past the end.

    Values are counted between approximate quantiles and the search goes on inside the one bucket
    that holds the position, until the bucket is small enough to sort.
    """
    column, kind = F.col(order), keys.schema[order].dataType
    steps = [i / _SLICE_BUCKETS for i in range(1, _SLICE_BUCKETS)]
    while True:
        cuts = sorted(set(keys.approxQuantile(order, steps, 1 / (4 * _SLICE_BUCKETS))))
        if isinstance(kind, IntegralType):
            # Edges of the column's own type reach the scan as plain comparisons.
            cuts = sorted({int(c) for c in cuts})
        edges = F.array(*[F.lit(c) for c in cuts]).cast(ArrayType(kind))
        bucket = F.size(F.filter(edges, lambda edge: edge < column))
        sizes = sorted(map(tuple, keys.groupBy(bucket.alias("bucket")).count().collect()))
        for number, size in sizes:
            if position < size:
                break
            position -= size
        else:
            return None
        if number > 0:
            keys = keys.filter(column > F.lit(cuts[number - 1]))
        if number < len(cuts):
            keys = keys.filter(column <= F.lit(cuts[number]))
        if size <= _SLICE_ROWS or len(sizes) == 1:
            return keys.orderBy(order).offset(position).first()[order]


def filter_period(df: DataFrame, column: str, period: str, reference: int | datetime) -> DataFrame:
    """Rows not older than a look-back period before a reference time.

    The reference is epoch seconds for integer columns and a ``datetime`` for timestamp columns, so
    the bound is a plain literal and reaches the scan.
    """
    seconds = catalog.PERIOD_SECONDS[period]
    if seconds is None:
        return df
    if isinstance(reference, datetime):
        earliest = (reference - timedelta(seconds=seconds)).isoformat(sep=" ")
        bound = F.lit(earliest).cast(df.schema[column].dataType)
    else:
        bound = F.lit(reference - seconds)
    return df.filter(F.col(column) >= bound)
