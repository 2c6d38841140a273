"""Cleaning: fill, dedupe, tag a drop reason, strip, flag names, split and report."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gabble import catalog
from gabble.functions import text as T
from gabble.operators.match import flag_names
from gabble.operators.select import first_per_key

DUPLICATE_KEY = ("comment", "persoon", "author", "thread_url")
TEXT_COLUMNS = ("comment", "thread_title")


def fill_text(df: DataFrame, columns: Iterable[str] = TEXT_COLUMNS) -> DataFrame:
    """Missing text becomes the empty string."""
    return df.withColumns({c: T.filled(F.col(c)) for c in columns})


def drop_duplicates(df: DataFrame, order: str = "ingest_order") -> DataFrame:
    """Keep the first of rows that agree on text, person, author and thread."""
    return first_per_key(df, DUPLICATE_KEY, [F.col(order)])


@dataclass(frozen=True)
class DropRules:
    """What the cleaning step drops. ``min_chars`` is off at 0."""

    bots: tuple[str, ...] = catalog.BOT_AUTHORS
    phrases: tuple[str, ...] = catalog.DELETED_PHRASES
    whole: tuple[str, ...] = catalog.DELETED_WHOLE
    min_chars: int = 0


def drop_reason(author: Column, comment: Column, rules: DropRules = DropRules()) -> Column:
    """First rule that hits: ``bot_author``, ``deleted_text``, then ``too_short`` if switched on;
    empty string for none."""
    reason = F.when(T.member(author, rules.bots), "bot_author").when(
        T.is_deleted_text(comment, rules.phrases, rules.whole), "deleted_text")
    if rules.min_chars > 0:
        reason = reason.when(F.length(comment) < rules.min_chars, "too_short")
    return reason.otherwise("")


def tag(df: DataFrame, rules: DropRules = DropRules(), order: str = "ingest_order") -> DataFrame:
    """Fill, dedupe, add ``drop_reason``, then strip the footer and white space.

    The reason is read before stripping, so footer texts are dropped, not repaired; the audit rows
    carry the stripped text.
    """
    return (
        fill_text(df)
        .transform(drop_duplicates, order)
        .withColumn("drop_reason", drop_reason(F.col("author"), F.col("comment"), rules))
        .withColumn("comment", T.strip_footer(F.col("comment")))
    )


def kept(tagged: DataFrame, entities: DataFrame) -> DataFrame:
    """Clean rows with ``name_in_comment`` and ``name_in_thread``."""
    return (
        tagged.filter(F.col("drop_reason") == "")
        .drop("drop_reason")
        .transform(flag_names, entities)
    )


def dropped(tagged: DataFrame) -> DataFrame:
    """Audit rows with their drop reason."""
    return tagged.filter(F.col("drop_reason") != "")


def report(df: DataFrame, rules: DropRules = DropRules()) -> DataFrame:
    """Row count per status (``kept``, a drop reason, ``duplicate``) and its share of the input.

    Author and text are part of the duplicate key, so one count per key carries both the reason and
    the number of copies. The key holds a digest of the text: copies of a hot text collapse before
    the shuffle, and no text moves at all.
    """
    per_key = (
        fill_text(df)
        .select(
            "persoon", "author", "thread_url",
            F.unhex(F.sha2(F.col("comment"), 256)).alias("digest"),
            drop_reason(F.col("author"), F.col("comment"), rules).alias("reason"))
        .groupBy("digest", "persoon", "author", "thread_url", "reason")
        .agg(F.count("*").alias("copies"))
    )
    by_reason = (
        per_key.groupBy(F.when(F.col("reason") == "", "kept").otherwise(F.col("reason"))
                        .alias("status"))
        .agg(F.count("*").alias("first"), F.sum(F.col("copies") - 1).alias("extra"))
    )
    counts = (
        by_reason.select(F.inline(F.array(
            F.struct("status", F.col("first").alias("n_rows")),
            F.struct(F.lit("duplicate").alias("status"), F.col("extra").alias("n_rows")),
        )))
        .groupBy("status")
        .agg(F.sum("n_rows").alias("n_rows"))
        .filter(F.col("n_rows") > 0)
    )
    # Only the few statuses are left, so their grand total is a window over one small group.
    n_input = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.round(F.col("n_rows") / n_input, 6))
