"""Helpers shared by the operators: row keys, Arrow passes, chunks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words; everything else belongs to a word.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """UTF-8 words: maximal runs without the characters of :data:`SPACES` (null: none)."""
    return text.encode().split() if text else []


def text_of(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(doc_id: str, text: str) -> Column:
    """Tells rows of one id with different texts apart; equal rows share it."""
    return F.xxhash64(F.col(doc_id), text_of(text))


def arrow_pass(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]],
               schema: str) -> DataFrame:
    """Apply ``work`` to each Arrow batch inside the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(run, schema)


def chunks(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a sequence into runs whose sizes sum to ``limit`` at most (a larger item stands alone)."""
    start = total = 0
    end = 0
    for end, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, end
            start, total = end, 0
        total += size
        end += 1
    if end > start:
        yield start, end


def by_id(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on null-safe keys; ``right`` brings its other columns, whose names must be new."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = one if on is None else on & one
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])
