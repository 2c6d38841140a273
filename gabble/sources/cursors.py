"""Search result pages in the order of their cursors.

A landed page holds the cursor that it was asked for (``cursor``, null for the first page of a search)
and the cursor of the page after it (``data.after``, null for the last page). Files may hold the pages
in any order, some twice, some not at all. The chain of each search is followed by pointer doubling:
round ``k`` knows the first ``2^k`` pages and jumps ``2^k`` pages ahead, so the longest search costs
``log2(pages)`` joins of narrow rows, and no task ever holds the pages of a whole search.

A page that was landed more than once counts once: the copy with the most results, then the smallest
digest. Pages behind a gap keep their threads, without a rank. An empty cursor counts as null. A chain
that runs into itself ends there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gabble.operators.select import key_digest, top_per_group
from gabble.session import written
from gabble.sources import landed

#: Columns that tell one search from another.
SEARCH = ("persoon", "query_index")

_PAGE = ["_search", "_at"]


def _keyed(pages: DataFrame, search: Sequence[str]) -> DataFrame:
    """Pages with the digest of their search, own and next cursor, number and digest of results."""
    return pages.withColumns({
        "_search": key_digest(search),
        "_at": F.coalesce("cursor", F.lit("")),
        "_next": F.nullif(F.col("data.after"), F.lit("")),
        "_n": F.coalesce(F.array_size("data.children"), F.lit(0)).cast("bigint"),
        "_digest": F.sha2(F.to_json("data"), 256),
    })


def _reached(links: DataFrame) -> DataFrame:
    """``_search, _at, page, offset`` of the pages that a chain leads to from the first one.

    ``links`` has one row per page: ``_search, _at, _next, _n``.
    """
    known = links.select("_search", F.col("_at").alias("_next"))
    jumps = written(links.join(known, ["_search", "_next"]).select(*_PAGE, "_next", "_n"), "jumps")
    reached = links.where("_at = ''").select(*_PAGE, F.lit(0).cast("bigint").alias("page"),
                                             F.lit(0).cast("bigint").alias("offset"))
    reached = written(reached, "reached")
    n, length = reached.count(), 1
    while n:
        ahead = reached.join(jumps, _PAGE).select(
            "_search", F.col("_next").alias("_at"), (F.col("page") + length).alias("page"),
            (F.col("offset") + F.col("_n")).alias("offset"))
        reached = written(
            reached.unionByName(ahead).groupBy(*_PAGE)
            .agg(F.min(F.struct("page", "offset")).alias("p")).select(*_PAGE, "p.page", "p.offset"), "reached")
        before, n = n, reached.count()
        if n == before:
            break
        second = jumps.select("_search", F.col("_at").alias("_next"), F.col("_next").alias("_far"),
                              F.col("_n").alias("_more"))
        jumps = written(jumps.join(second, ["_search", "_next"]).select(
            *_PAGE, F.col("_far").alias("_next"), (F.col("_n") + F.col("_more")).alias("_n")), "jumps")
        length *= 2
    return reached


def _narrow(pages: DataFrame, search: Sequence[str]) -> DataFrame:
    """All that following the cursors needs of the landed pages; no result of a page is in it."""
    return _keyed(pages, search).select(*search, *_PAGE, "_next", "_n", "_digest")


def _followed(narrow: DataFrame) -> DataFrame:
    """The copy of each page that counts, with ``page`` and ``offset``."""
    one = written(top_per_group(narrow, _PAGE, [F.col("_n").desc(), F.col("_digest")], 1), "pages")
    return one.join(_reached(one.select(*_PAGE, "_next", "_n")), _PAGE, "left")


def in_order(pages: DataFrame, search: Sequence[str] = SEARCH) -> DataFrame:
    """Each page once, with ``page`` (0 for the first of its search) and ``offset``, the number of
    results on the pages before it; both null where no chain leads to the page.

    The pages with their results are shuffled once, after the copies that do not count are gone.
    """
    order = written(_followed(_narrow(pages, search)).select(*_PAGE, "_digest", "page", "offset"), "order")
    kept = _keyed(pages, search).join(order, [*_PAGE, "_digest"])
    return top_per_group(kept, _PAGE, [F.col("_n")], 1).drop(*_PAGE, "_next", "_n", "_digest")


def read_listing(spark: SparkSession, path: str, limit: int | None = None,
                 multi_line: bool = False) -> DataFrame:
    """Listed threads with ``page`` and ``listing_rank`` (from 0), the order in which the search listed them.

    Both are null behind a missing page, which :func:`audit` reports. A ``limit`` keeps the first
    threads of each search and leaves out those without a rank.
    """
    pages = in_order(landed.read_listing_pages(spark, path, multi_line))
    listed = pages.select("persoon", "query_index", "page", "offset",
                          F.posexplode("data.children.data").alias("at", "t"))
    listed = listed.select("persoon", "query_index", *landed.thread_columns(), "page",
                           (F.col("offset") + F.col("at")).alias("listing_rank"))
    return listed if limit is None else listed.where(F.col("listing_rank") < limit)


def audit(pages: DataFrame, search: Sequence[str] = SEARCH) -> DataFrame:
    """Search columns, ``cursor``, ``problem`` and ``n_landed`` of what is wrong with the landed pages.

    ``missing``: a page that another one points to, or the first page of a search, was not landed.
    ``repeated``: it was landed more than once. ``unreachable``: no chain leads from the first page to it.
    """
    narrow = written(_narrow(pages, search), "landed")
    stored = written(narrow.groupBy(*_PAGE).agg(F.count("*").alias("n_landed")).join(
        _followed(narrow).select(*search, *_PAGE, "_next", "page"), _PAGE), "stored")
    wanted = stored.where("_next is not null").select(*search, "_search", F.col("_next").alias("_at")).unionByName(
        stored.select(*search, "_search", F.lit("").alias("_at"))).dropDuplicates(_PAGE)
    missing = wanted.join(stored, _PAGE, "left_anti").withColumns(
        {"problem": F.lit("missing"), "n_landed": F.lit(0).cast("bigint")})
    wrong = stored.withColumn("problem", F.explode(F.filter(F.array(
        F.when(F.col("n_landed") > 1, "repeated"), F.when(F.col("page").isNull(), "unreachable")), lambda p: p.isNotNull())))
    columns = [*search, F.nullif(F.col("_at"), F.lit("")).alias("cursor"), "problem", "n_landed"]
    return missing.select(columns).unionByName(wrong.select(columns))
