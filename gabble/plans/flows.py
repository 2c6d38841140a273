"""The study's multi-step flows, put together from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gabble import catalog
from gabble.catalog import Entity, entity_frame
from gabble.functions import text as T
from gabble.operators import clean, match, report, score, select

def search_threads(threads: DataFrame, comments: DataFrame, entities: Sequence[Entity]) -> DataFrame:
    """Threads found per person: a search phrase occurs in the title or in any comment.

    One row per person and thread with the thread's columns and the latest search that found it.
    The hits of one thread collapse in the map tasks.
    """
    in_title = match.search(threads, entities, "title", ["thread_id"])
    in_body = match.search(comments, entities, "comment", ["thread_id"])
    hits = in_title.unionByName(in_body).groupBy("persoon", "thread_id").agg(
        F.max("query_index").alias("query_index"))
    return hits.join(threads, "thread_id")


def choose_threads(found: DataFrame, people: DataFrame,
                   limit: int | None = catalog.MAX_THREADS_PER_PERSON) -> DataFrame:
    """The threads to read per person: at most ``limit`` (``None``: all), those about the person first.

    ``found`` has one row per person and thread.
    """
    return (
        match.tier(found, people)
        .transform(select.thread_budget, limit)
        .select("persoon", "tier", "thread_id", F.col("score").alias("thread_score"),
                F.col("url").alias("thread_url"), F.col("title").alias("thread_title"), "subreddit")
    )


def join_threads(comments: DataFrame, threads: DataFrame) -> DataFrame:
    """Comments with the columns of their thread (and its person and tier).

    Spark broadcasts the threads if their measured bytes allow it; else a huge thread's partition
    is split at run time.
    """
    return comments.join(threads, "thread_id")


def gather_comments(comments: DataFrame, chosen: DataFrame, people: DataFrame) -> DataFrame:
    """Live comments of the chosen threads, filtered by tier, once per person, with the gender."""
    live = comments.filter(T.is_live_body(F.col("comment")))
    return (
        join_threads(live, chosen)
        .transform(match.filter_tier, people)
        .transform(select.dedupe_by_priority)
        .transform(match.attach_entity, people, ["gender"])
    )


def collect_comments(listing: DataFrame, comments: DataFrame, entities: Sequence[Entity],
                     limit: int | None = catalog.MAX_THREADS_PER_PERSON) -> DataFrame:
    """The comment table of all persons from landed search results and comment trees."""
    people = entity_frame(listing.sparkSession, entities)
    chosen = choose_threads(select.unify_threads(listing), people, limit)
    return gather_comments(comments, chosen, people)


def negative_report(raw: DataFrame, negative: Sequence[str]) -> DataFrame:
    """Clean, score with a word list and report the negative rate per person.

    Drop reason, label and a digest of the duplicate key are read off the text where it is scanned;
    only they are shuffled.
    """
    texts = clean.fill_text(raw)
    told = (
        texts.withColumn("_key", select.key_digest(clean.DUPLICATE_KEY))
        .withColumn("drop_reason", clean.drop_reason(F.col("author"), F.col("comment")))
        .withColumn("comment", T.strip_footer(F.col("comment")))
        .transform(score.negative_flag, negative=negative)
        .select("_key", "ingest_order", "persoon", "gender", "drop_reason", "sentiment")
    )
    first = select.top_per_group(told, ["_key"], [F.col("ingest_order")], 1)
    return first.filter(F.col("drop_reason") == "").transform(report.negative_rate)
