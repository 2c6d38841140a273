"""Queries: matching to persons, searching, selecting, sampling."""

from datetime import datetime

from pyspark.sql import functions as F

from gabble.catalog import entity_frame
from gabble.operators import match, report, select
from gabble.plans import bindings as B
from gabble.plans import flows
from gabble.plans.bindings import fold_sql, in_sql, sql
from gabble.plans.queries_clean import hit_folded, hit_lower
from gabble.plans.registry import query
from gabble.session import written

_BUDGET = 20
_CAP = 15
_REFERENCE_TIME = datetime(2024, 1, 31)

#: SQL steps of the collection flow, shared by several checks.
_HITS = f"""asked AS (SELECT persoon, unnest(search_queries) AS phrase FROM people),
  texts AS (SELECT thread_id, title AS t FROM threads
    UNION ALL SELECT thread_id, comment FROM thread_comments),
  found AS (SELECT DISTINCT persoon, thread_id FROM texts, asked
    WHERE contains({fold_sql('t')}, {fold_sql('phrase')})),
  tiered AS (SELECT persoon, threads.*,
      CASE WHEN {hit_folded('title', 'title_variants')} THEN 1 ELSE 2 END AS tier
    FROM found JOIN threads USING (thread_id) JOIN people USING (persoon))"""
_COLLECTED = f"""{_HITS},
  chosen AS (SELECT * FROM tiered),
  collected AS (SELECT persoon, comment_id, author, comment, thread_id, url AS thread_url,
      title AS thread_title, subreddit, tier, score AS thread_score, gender
    FROM thread_comments JOIN chosen USING (thread_id) JOIN people USING (persoon)
    WHERE comment NOT IN ('', '[deleted]', '[removed]')
      AND (tier = 1 OR {hit_folded('comment', 'strict_variants')})
    QUALIFY row_number() OVER (PARTITION BY persoon, comment_id
      ORDER BY tier, score DESC, thread_id) = 1)"""


def _found(spark, d):
    return flows.search_threads(B.threads(spark, d), B.thread_comments(spark, d), B.PEOPLE)


def _chosen(spark, d):
    return flows.choose_threads(_found(spark, d), entity_frame(spark, B.PEOPLE), None)


def _gathered(spark, d, chosen):
    return flows.gather_comments(B.thread_comments(spark, d), chosen, entity_frame(spark, B.PEOPLE))


def _found_tiered(spark, d):
    return match.tier(select.unify_threads(B.found_threads(spark, d)),
                      entity_frame(spark, B.PEOPLE))


@query(sql(f"""SELECT comment_id, {hit_folded('thread_title', 'title_variants')} AS about
  FROM comments JOIN people USING (persoon)""", "comments", "people"))
def match_title(spark, d):
    people = entity_frame(spark, B.PEOPLE)
    return match.match_title(B.comments(spark, d), people).select("comment_id", "about")


@query(sql(f"""SELECT comment_id, {hit_folded('comment', 'strict_variants')} AS mentioned
  FROM comments JOIN people USING (persoon)""", "comments", "people"))
def match_comment(spark, d):
    people = entity_frame(spark, B.PEOPLE)
    return match.match_comment(B.comments(spark, d), people).select("comment_id", "mentioned")


@query(sql(f"""SELECT comment_id, {hit_lower('comment', 'loose_variants')} AS name_in_comment,
  {hit_lower('thread_title', 'loose_variants')} AS name_in_thread
  FROM raw JOIN people USING (persoon)""", "raw", "people"))
def flag_name_hits(spark, d):
    people = entity_frame(spark, B.PEOPLE)
    return match.flag_names(B.raw(spark, d), people).select(
        "comment_id", "name_in_comment", "name_in_thread")


@query(sql(f"""SELECT comment_id, comment FROM raw
  WHERE contains({fold_sql('comment')}, {fold_sql("'Réleou'")})""", "raw"))
def filter_phrase(spark, d):
    return match.filter_phrase(B.raw(spark, d), "Réleou").select("comment_id", "comment")


@query(sql(f"""SELECT comment_id, t.persoon, query_index FROM (
    SELECT persoon, unnest(search_queries) AS phrase,
      CAST(generate_subscripts(search_queries, 1) - 1 AS INTEGER) AS query_index FROM people) t, comments
  WHERE contains({fold_sql('comment')}, {fold_sql('phrase')})""", "comments", "people"))
def search_phrases(spark, d):
    return match.search(B.comments(spark, d), B.PEOPLE, "comment", ["comment_id"])


@query(f"""WITH asked AS (SELECT DISTINCT 'b' || item_id AS persoon, CAST(k AS INTEGER) AS query_index,
    {fold_sql("substr(text, k * 40 + 1, 3 + 5 * (k + 1))")} AS phrase
    FROM benchmark, (SELECT unnest(range(6)) AS k) WHERE length(text) > k * 40)
  SELECT doc_id, persoon, query_index FROM documents, asked WHERE contains({fold_sql('text')}, phrase)""")
def search_many_names(spark, d):
    """Six phrases of each benchmark item, of 8 to 33 characters, in all documents."""
    asked = B.table(spark, d, "benchmark").select("item_id", "text", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).where(
        "length(text) > k * 40").selectExpr("concat('b', item_id) AS persoon", "k AS query_index", "substr(text, k * 40 + 1, 3 + 5 * (k + 1)) AS phrase")
    return match.search_many(B.table(spark, d, "documents"), asked.distinct(), "text", ["doc_id"])


@query(sql(f"WITH {_HITS} SELECT persoon, thread_id, title, score, tier FROM tiered",
           "people", "threads", "thread_comments"))
def join_tier_theta(spark, d):
    return match.tier(_found(spark, d), entity_frame(spark, B.PEOPLE)).select(
        "persoon", "thread_id", "title", "score", "tier")


@query(sql("""SELECT comment_id, author, comment, thread_id, url, title, subreddit
  FROM thread_comments JOIN threads USING (thread_id)""", "threads", "thread_comments"))
def join_thread_comments(spark, d):
    return flows.join_threads(B.thread_comments(spark, d), B.threads(spark, d)).select(
        "comment_id", "author", "comment", "thread_id", "url", "title", "subreddit")


@query(sql(f"""WITH {_COLLECTED} SELECT persoon, comment_id, author, comment, thread_id, thread_url,
  thread_title, subreddit, tier, thread_score, gender FROM collected""",
           "people", "threads", "thread_comments"))
def collected_comments(spark, d):
    return _gathered(spark, d, _chosen(spark, d)).select(
        "persoon", "comment_id", "author", "comment", "thread_id", "thread_url", "thread_title",
        "subreddit", "tier", "thread_score", "gender")


@query(sql(f"""SELECT comment_id, persoon, tier FROM (
    SELECT comment_id, persoon, comment, strict_variants,
      CASE WHEN {hit_folded('thread_title', 'title_variants')} THEN 1 ELSE 2 END AS tier
    FROM comments JOIN people USING (persoon))
  WHERE tier = 1 OR {hit_folded('comment', 'strict_variants')}""", "comments", "people"))
def filter_tier(spark, d):
    people = entity_frame(spark, B.PEOPLE)
    return (
        match.tier(B.comments(spark, d), people, "thread_title")
        .transform(match.filter_tier, people)
        .select("comment_id", "persoon", "tier")
    )


@query(sql("""SELECT persoon, thread_id, title, subreddit, query_index, score FROM found_threads
  QUALIFY row_number() OVER (PARTITION BY persoon, thread_id ORDER BY query_index DESC) = 1""",
           "found_threads"))
def dedupe_threads(spark, d):
    return select.unify_threads(B.found_threads(spark, d))


_FOUND_TIERED = f"""unified AS (SELECT * FROM found_threads QUALIFY row_number() OVER (
    PARTITION BY persoon, thread_id ORDER BY query_index DESC) = 1),
  tiered AS (SELECT unified.*,
      CASE WHEN {hit_folded('title', 'title_variants')} THEN 1 ELSE 2 END AS tier
    FROM unified JOIN people USING (persoon))"""


@query(sql(f"""WITH {_FOUND_TIERED} SELECT persoon, thread_id, tier, score FROM tiered
  QUALIFY row_number() OVER (
    PARTITION BY persoon ORDER BY tier, score DESC, thread_id) <= {_BUDGET}""",
           "found_threads", "people"))
def topk_budget(spark, d):
    return select.thread_budget(_found_tiered(spark, d), _BUDGET).select(
        "persoon", "thread_id", "tier", "score")


@query(sql(f"""SELECT persoon, query_index, thread_id, score FROM found_threads
  QUALIFY row_number() OVER (
    PARTITION BY persoon, query_index ORDER BY score DESC, thread_id) <= {_CAP}""",
           "found_threads"))
def limit_per_group(spark, d):
    return select.cap_per_group(
        B.found_threads(spark, d), ["persoon", "query_index"],
        [F.col("score").desc(), F.col("thread_id")], _CAP,
    ).select("persoon", "query_index", "thread_id", "score")


@query(sql("""SELECT persoon, 'c' || conv_id AS comment_id, tier, score AS thread_score, thread_id
  FROM (SELECT 'p' || (conv_id % 6) AS persoon, conv_id, 't' || (turn % 3) AS thread_id,
      1 + turn % 2 AS tier, CAST(length(text) AS BIGINT) AS score FROM conversations)
  QUALIFY row_number() OVER (PARTITION BY persoon, conv_id
    ORDER BY tier, score DESC, thread_id) = 1"""))
def dedupe_priority(spark, d):
    listed = B.table(spark, d, "conversations").selectExpr(
        "concat('p', conv_id % 6) AS persoon", "concat('c', conv_id) AS comment_id",
        "1 + turn % 2 AS tier", "cast(length(text) AS bigint) AS thread_score",
        "concat('t', turn % 3) AS thread_id")
    return select.dedupe_by_priority(listed)


@query(sql(f"""SELECT comment_id, subreddit FROM raw
  WHERE subreddit IN ({in_sql(B.ALLOWLIST)})""", "raw"))
def filter_allowlist(spark, d):
    return match.filter_allowlist(B.raw(spark, d), B.ALLOWLIST).select("comment_id", "subreddit")


_MENTION = f"""SELECT comment_id, subreddit, ingest_order FROM raw JOIN people USING (persoon)
  WHERE subreddit IN ({in_sql(B.ALLOWLIST)}) AND (subreddit NOT IN ({in_sql(B.GENERAL)})
    OR coalesce(contains(lower(comment), lower(title_variants[1])), false))"""


def _general(spark, d):
    people = entity_frame(spark, B.PEOPLE).select(
        "persoon", F.get("title_variants", F.lit(0)).alias("name"))
    rows = match.filter_allowlist(B.raw(spark, d), B.ALLOWLIST).join(people, "persoon")
    return match.filter_general(rows, B.GENERAL, name="name")


@query(sql(f"SELECT comment_id, subreddit FROM ({_MENTION})", "raw", "people"))
def filter_general_mention(spark, d):
    return _general(spark, d).select("comment_id", "subreddit")


@query(sql(f"""SELECT comment_id, ingest_order FROM ({_MENTION})
  ORDER BY ingest_order LIMIT 1000 OFFSET 100""", "raw", "people"))
def slice_rows(spark, d):
    return select.slice_rows(_general(spark, d), 100, 1100).select("comment_id", "ingest_order")


@query("""SELECT event_id, ts FROM events
  WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 604800 SECOND""")
def filter_period(spark, d):
    return select.filter_period(B.table(spark, d, "events"), "ts", "week", _REFERENCE_TIME).select(
        "event_id", "ts")


@query(sql("""SELECT persoon, gender, subreddit, comment, '' AS manual_label, '' AS model_deberta,
  '' AS model_gpt, '' AS model_claude FROM comments WHERE comment IS NOT NULL
  QUALIFY row_number() OVER (
    PARTITION BY persoon ORDER BY md5('42|' || comment_id), comment_id) <= 10""", "comments"))
def sample_label_sheet(spark, d):
    return select.label_sheet(B.comments(spark, d))


@query(sql("""SELECT comment_id, persoon, comment FROM raw
  QUALIFY row_number() OVER (
    PARTITION BY persoon ORDER BY md5('42|' || comment_id), comment_id) <= 16""", "raw"))
def sample_per_group(spark, d):
    return select.sample_per_group(B.raw(spark, d), ["persoon"], 16).select(
        "comment_id", "persoon", "comment")


@query(sql(f"""WITH {_COLLECTED}, per_thread AS (
    SELECT persoon, thread_id, count(*) AS n FROM collected GROUP BY ALL)
  SELECT people.persoon, gender, CAST(coalesce(sum(n), 0) AS BIGINT) AS comments,
    count(chosen.thread_id) FILTER (WHERE n IS NULL) AS threads_empty
  FROM people LEFT JOIN chosen USING (persoon) LEFT JOIN per_thread USING (persoon, thread_id)
  GROUP BY people.persoon, gender""", "people", "threads", "thread_comments"))
def agg_overview(spark, d):
    # The search reads every text; both sides of the report share its small, written result.
    chosen = written(_chosen(spark, d), "chosen")
    return report.overview(entity_frame(spark, B.PEOPLE), chosen, _gathered(spark, d, chosen))


@query(sql(f"""WITH {_COLLECTED}, per_thread AS (
    SELECT persoon, thread_id, count(*) AS n FROM collected GROUP BY ALL)
  SELECT persoon, CAST(coalesce(sum(n) FILTER (WHERE tier = 1), 0) AS BIGINT) AS tier1_comments,
    CAST(coalesce(sum(n) FILTER (WHERE tier = 2), 0) AS BIGINT) AS tier2_comments,
    count(*) FILTER (WHERE n IS NULL AND thread_id IS NOT NULL) AS threads_empty
  FROM (SELECT persoon FROM people) LEFT JOIN chosen USING (persoon)
  LEFT JOIN per_thread USING (persoon, thread_id) GROUP BY persoon""",
           "people", "threads", "thread_comments"))
def agg_tier_report(spark, d):
    chosen = written(_chosen(spark, d), "chosen")
    return report.tier_report(entity_frame(spark, B.PEOPLE), chosen, _gathered(spark, d, chosen))


@query(sql(f"""WITH {_FOUND_TIERED} SELECT persoon,
  count(DISTINCT thread_id) FILTER (WHERE tier = 1) AS tier1_threads,
  count(DISTINCT thread_id) FILTER (WHERE tier = 2) AS tier2_threads,
  count(DISTINCT thread_id) AS all_threads
  FROM (SELECT persoon FROM people) LEFT JOIN tiered USING (persoon) GROUP BY persoon""",
           "found_threads", "people"))
def agg_tier_sizes(spark, d):
    return report.tier_sizes(entity_frame(spark, B.PEOPLE), _found_tiered(spark, d))
