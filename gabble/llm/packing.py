"""Packing into optimal length buckets.

Documents are cut into pieces of ``max_len`` tokens at most. The histogram of piece lengths over all data has
at most ``max_len + 1`` rows; dynamic programming over it chooses the bucket boundaries with the least padding.
Inside each bucket, in order of document and piece, a batch takes as many pieces as ``token_budget`` holds at
the bucket's length. A bucket with a third of the pieces is numbered in parts of ``PART`` document ids, and
running totals of the parts give each its first number, so no task gets a whole bucket.

Edge cases: a null or empty text is one piece of length 0 in the first bucket; null ids come first; rows that
repeat an id are told apart by text hash, equal rows are interchangeable; an empty table gives an empty result;
fewer lengths than buckets make fewer buckets; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gabble.llm.common import row_key, text_of
from gabble.session import written

MAX_LEN = 2048
BUCKETS = 8
TOKEN_BUDGET = 16_384
PART = 4096

#: A token: letters, digits, or other signs in a row. Any count of a text can take its place.
TOKEN = r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]+"


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """The upper lengths of at most ``buckets`` buckets with the least padding; ties: the lower boundary."""
    order = np.argsort(np.array(lengths, np.int64))
    length = np.array(lengths, np.int64)[order]
    count = np.array(counts, np.int64)[order]
    n = len(length)
    if n == 0:
        return []
    pieces = np.concatenate([[0], np.cumsum(count)])
    tokens = np.concatenate([[0], np.cumsum(count * length)])
    far = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, far, np.int64)
    best[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        new, source = np.full(n + 1, far, np.int64), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + length[j - 1] * (pieces[j] - pieces[:j]) - (tokens[j] - tokens[:j])
            source[j] = int(np.argmin(cost))
            new[j] = cost[source[j]]
        back.append(source)
        best = new
    at, tops = n, []
    for source in reversed(back):
        tops.append(int(length[at - 1]))
        at = int(source[at])
    return tops[::-1]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_len: int = MAX_LEN,
           tokens: Column | None = None) -> DataFrame:
    """``doc_id, row_key, piece, n_tokens``; ``tokens`` counts a document's tokens."""
    tokens = count_tokens(text_of(text)) if tokens is None else F.coalesce(tokens, F.lit(0))
    counted = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"),
                          tokens.cast("int").alias("total"))
    last = F.greatest(F.lit(0), F.expr(f"(total - 1) div {max_len}").cast("int"))
    return (counted.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
            .select("doc_id", "row_key", "piece",
                    F.least(F.col("total") - F.col("piece") * max_len, F.lit(max_len)).alias("n_tokens")))


def numbered(df: DataFrame, group: str, doc_id: str, order: list[str], part: int = PART) -> DataFrame:
    """Adds ``position``, from 0 on inside each group, without a task for a whole group."""
    parted = df.withColumn("_part", F.coalesce(F.expr(f"{doc_id} div {part}"), F.lit(-(1 << 62))))
    sizes = parted.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per group and 4,096 ids.
    offsets = sizes.withColumn("_first", F.sum("_size").over(
        Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_size")
    own = Window.partitionBy(group, "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return (parted.withColumn("_own", F.row_number().over(own)).join(offsets, [group, "_part"])
            .withColumn("position", F.coalesce("_first", F.lit(0)) + F.col("_own") - 1)
            .drop("_part", "_own", "_first"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_len: int = MAX_LEN,
         buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, tokens: Column | None = None) -> DataFrame:
    """``doc_id, piece, n_tokens, bucket_len, batch, slot, padding``: one row per piece."""
    cut = written(pieces(docs, doc_id, text, max_len, tokens), "pieces")
    histogram = cut.groupBy("n_tokens").count().collect()  # at most max_len + 1 rows
    tops = boundaries([r["n_tokens"] for r in histogram], [r["count"] for r in histogram], buckets)
    bucket = F.lit(None).cast("int")
    for top in reversed(tops):
        bucket = F.when(F.col("n_tokens") <= top, F.lit(top)).otherwise(bucket)
    placed = numbered(cut.withColumn("bucket_len", bucket), "bucket_len", "doc_id", ["doc_id", "row_key", "piece"])
    room = F.greatest(F.expr(f"{token_budget} div greatest(bucket_len, 1)"), F.lit(1))
    return placed.select(
        "doc_id", "piece", "n_tokens", "bucket_len", F.floor(F.col("position") / room).alias("batch"),
        (F.col("position") % room).alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
