"""Queries: projections, cleaning, text functions."""

from pyspark.sql import functions as F

from gabble import catalog
from gabble.catalog import entity_frame
from gabble.functions import modeltext as M
from gabble.functions import text as T
from gabble.operators import clean, match
from gabble.plans import bindings as B
from gabble.plans.bindings import in_sql, sql
from gabble.plans.registry import query
from gabble.session import scratch_dir
from gabble.sources import sinks

_DELETED = (
    "(comment IN ('[deleted]', '[removed]') OR regexp_matches(comment, "
    r"'(?i)This post was mass deleted|This comment was removed|^\s*deleted\s*$|^\.\s*$'))"
)
_REASON = f"""CASE WHEN author IN ({in_sql(catalog.BOT_AUTHORS)}) THEN 'bot_author'
  WHEN {_DELETED} THEN 'deleted_text' ELSE '' END"""
_STRIP = (
    r"regexp_replace({0}, '^[\s\x{{a0}}\x{{85}}\x{{2000}}-\x{{200a}}]+"
    r"|[\s\x{{a0}}\x{{85}}\x{{2000}}-\x{{200a}}]+$', '', 'g')"
)
_STRIP_FOOTER = _STRIP.format(
    r"regexp_replace(comment, '\n*\*?This post was mass deleted.*?\*?$', '', 'g')")
_FIRST = """filled AS (SELECT * REPLACE (coalesce(comment, '') AS comment,
    coalesce(thread_title, '') AS thread_title) FROM raw),
  firsts AS (SELECT * FROM filled QUALIFY row_number() OVER (
    PARTITION BY comment, persoon, author, thread_url ORDER BY ingest_order) = 1)"""
TAGGED = f"""{_FIRST}, tagged AS (
  SELECT * REPLACE ({_STRIP_FOOTER} AS comment), {_REASON} AS drop_reason FROM firsts)"""


def _hit(text: str, variants: str, prepare) -> str:
    """SQL for: the text contains any variant."""
    return (f"coalesce(len(list_filter({variants}, "
            f"lambda v: contains({prepare(text)}, {prepare('v')}))) > 0, false)")


def hit_folded(text: str, variants: str) -> str:
    return _hit(text, variants, B.fold_sql)


def hit_lower(text: str, variants: str) -> str:
    return _hit(text, variants, lambda e: f"lower({e})")


_FLAGS = f"""{hit_lower('comment', 'loose_variants')} AS name_in_comment,
  {hit_lower('thread_title', 'loose_variants')} AS name_in_thread"""


@query(sql("SELECT comment_id, persoon, gender, subreddit, comment FROM comments", "comments"))
def proj_subset(spark, d):
    return B.comments(spark, d).select("comment_id", "persoon", "gender", "subreddit", "comment")


@query("""SELECT doc_id, 'https://www.reddit.com' || '/r/' || source || '/d' || doc_id AS url
  FROM documents""")
def proj_url(spark, d):
    path = F.concat(F.lit("/r/"), "source", F.lit("/d"), "doc_id")
    return B.table(spark, d, "documents").select("doc_id", T.absolute_url(path).alias("url"))


@query("""SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, -1) AS toxic
  FROM documents LEFT JOIN labels USING (doc_id)""")
def proj_defaults(spark, d):
    joined = B.table(spark, d, "documents").select("doc_id").join(
        B.table(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", T.default(F.col("quality"), 0).alias("quality"),
                         T.default(F.col("toxic"), -1).alias("toxic"))


@query(sql("""SELECT comment_id, coalesce(comment, '') AS comment,
  coalesce(thread_title, '') AS thread_title FROM raw""", "raw"))
def proj_fill_text(spark, d):
    return clean.fill_text(B.raw(spark, d)).select("comment_id", "comment", "thread_title")


@query(sql("""SELECT comment_id, comment FROM raw
  WHERE comment <> '' AND comment NOT IN ('[deleted]', '[removed]')""", "raw"))
def filter_deleted_exact(spark, d):
    return B.raw(spark, d).filter(T.is_live_body(F.col("comment"))).select("comment_id", "comment")


@query(sql(f"""SELECT comment_id, author,
  coalesce(author IN ({in_sql(catalog.BOT_AUTHORS)}), false) AS is_bot FROM raw""", "raw"))
def tag_bot_author(spark, d):
    return B.raw(spark, d).select(
        "comment_id", "author", T.member(F.col("author"), catalog.BOT_AUTHORS).alias("is_bot"))


@query(sql(f"SELECT comment_id, coalesce({_DELETED}, false) AS is_deleted FROM raw", "raw"))
def tag_deleted_text(spark, d):
    return B.raw(spark, d).select(
        "comment_id", T.is_deleted_text(F.col("comment")).alias("is_deleted"))


@query(sql(f"""SELECT comment_id, {_REASON} AS drop_reason
  FROM (SELECT * REPLACE (coalesce(comment, '') AS comment) FROM raw)""", "raw"))
def tag_drop_reason(spark, d):
    return clean.fill_text(B.raw(spark, d)).select(
        "comment_id", clean.drop_reason(F.col("author"), F.col("comment")).alias("drop_reason"))


@query(sql(f"WITH {_FIRST} SELECT comment_id, persoon, author, thread_url, comment FROM firsts",
           "raw"))
def dedupe_first(spark, d):
    return clean.fill_text(B.raw(spark, d)).transform(clean.drop_duplicates).select(
        "comment_id", "persoon", "author", "thread_url", "comment")


@query(sql(f"""WITH {TAGGED} SELECT comment_id, comment, author, t.persoon, thread_title, {_FLAGS}
  FROM tagged t LEFT JOIN people USING (persoon) WHERE drop_reason = ''""", "raw", "people"))
def clean_kept(spark, d):
    people = entity_frame(spark, B.PEOPLE)
    return clean.kept(clean.tag(B.raw(spark, d)), people).select(
        "comment_id", "comment", "author", "persoon", "thread_title",
        "name_in_comment", "name_in_thread")


@query(sql(f"""WITH {TAGGED} SELECT comment_id, comment, author, persoon, drop_reason
  FROM tagged WHERE drop_reason <> ''""", "raw"))
def clean_dropped(spark, d):
    return clean.dropped(clean.tag(B.raw(spark, d))).select(
        "comment_id", "comment", "author", "persoon", "drop_reason")


@query(sql(f"""WITH {TAGGED} SELECT comment_id, comment,
  drop_reason = '' AS kept FROM tagged""", "raw"))
def snk_split(spark, d):
    path = scratch_dir(spark, "split")
    sinks.write_split(clean.tag(B.raw(spark, d)), path)
    kept = sinks.read_kept(spark, path).withColumn("kept", F.lit(True))
    audit = sinks.read_dropped(spark, path).withColumn("kept", F.lit(False))
    return kept.unionByName(audit, allowMissingColumns=True).select("comment_id", "comment", "kept")


@query(sql(f"""WITH {TAGGED}, counts AS (
    SELECT CASE WHEN drop_reason = '' THEN 'kept' ELSE drop_reason END AS status, count(*) AS n_rows
    FROM tagged GROUP BY 1
    UNION ALL SELECT 'duplicate', (SELECT count(*) FROM raw) - (SELECT count(*) FROM firsts))
  SELECT status, CAST(n_rows AS BIGINT) AS n_rows,
    {B.round_sql('n_rows * 1.0 / (SELECT count(*) FROM raw)', 6)} AS share
  FROM counts WHERE n_rows > 0""", "raw"))
def agg_clean_report(spark, d):
    return clean.report(B.raw(spark, d))


@query(sql(f"SELECT comment_id, {_STRIP_FOOTER} AS comment FROM raw", "raw"))
def str_strip_footer(spark, d):
    return B.raw(spark, d).select("comment_id", T.strip_footer(F.col("comment")).alias("comment"))


@query(sql(r"""SELECT comment_id,
  regexp_replace(comment, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS comment FROM raw""", "raw"))
def str_strip_control(spark, d):
    return sinks.printable(B.raw(spark, d).select("comment_id", "comment"))


@query(sql(f"SELECT comment_id, {B.fold_sql('comment')} AS folded FROM comments", "comments"))
def str_fold(spark, d):
    return B.comments(spark, d).select("comment_id", T.fold(F.col("comment")).alias("folded"))


@query(sql("""SELECT comment_id, substr(comment, 1, 400) AS comment_400,
  substr(comment, 1, 1500) AS comment_1500, substr(thread_title, 1, 100) AS title_100,
  length(comment) AS n_chars FROM raw""", "raw"))
def str_truncate(spark, d):
    comment, title = F.col("comment"), F.col("thread_title")
    return B.raw(spark, d).select(
        "comment_id", T.truncate(comment, 400).alias("comment_400"),
        T.truncate(comment, 1500).alias("comment_1500"),
        T.truncate(title, 100).alias("title_100"),
        F.length(comment).cast("bigint").alias("n_chars"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS date,
  CAST(floor(epoch(ts)) AS BIGINT) AS timestamp FROM events""")
def date_from_epoch(spark, d):
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return B.table(spark, d, "events").select(
        "event_id", T.utc_date(seconds).alias("date"), T.epoch_seconds(seconds).alias("timestamp"))


_CONTROL_FREE = r"regexp_replace({0}, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')"


@query(sql(f"""SELECT comment_id, '[Subreddit: r/' || subreddit || ' | Thread: '
  || {_CONTROL_FREE.format('thread_title')} || ']' || chr(10) || 'Comment: '
  || {_CONTROL_FREE.format("coalesce(comment, '')")} AS context FROM raw""", "raw"))
def str_context(spark, d):
    return clean.fill_text(B.raw(spark, d)).select(
        "comment_id",
        M.context(F.col("subreddit"), F.col("thread_title"), F.col("comment")).alias("context"))


@query(sql("""SELECT comment_id, 'Answer in JSON.' || chr(10) || 'Target skater: '
  || coalesce(description, c.persoon) || chr(10) || 'Thread title: ' || thread_title || chr(10)
  || 'Subreddit: r/' || subreddit || chr(10) || 'Comment: ' || comment || chr(10) || chr(10)
  || 'JSON:' AS prompt
  FROM comments c LEFT JOIN (SELECT * FROM people WHERE persoon <> 'p5') USING (persoon)""",
           "comments", "people"))
def str_prompt(spark, d):
    known = entity_frame(spark, B.PEOPLE[:5])
    return match.described(B.comments(spark, d), known).select(
        "comment_id",
        M.prompt(F.col("description"), F.col("subreddit"), F.col("thread_title"),
                 F.col("comment"), preamble="Answer in JSON.\n").alias("prompt"))


@query(sql(f"""SELECT comment_id,
  CASE WHEN subreddit IN ({in_sql(B.OFF_TOPIC)}) THEN 'this comment evaluates or describes '
      || full_name || ', Dutch speed skater (' || pronoun || ')'
    ELSE 'this comment evaluates or describes ' || persoon || ' (' || pronoun || ')' END AS about,
  CASE WHEN subreddit IN ({in_sql(B.OFF_TOPIC)}) THEN 'this comment is not about '
      || full_name || ' or contains no evaluation of ' || full_name
    ELSE 'this comment is not about ' || persoon || ' or contains no evaluation' END AS not_about,
  'this comment is about ' || persoon || ' as an athlete or person' AS about_simple,
  'this comment is not about ' || persoon AS not_about_simple,
  CASE WHEN c.gender = 'vrouw' THEN 'she/her' ELSE 'he/him' END AS pronoun_of_gender
  FROM comments c JOIN people USING (persoon)""", "comments", "people"))
def str_candidate_labels(spark, d):
    people = entity_frame(spark, B.PEOPLE)
    rows = match.attach_entity(B.comments(spark, d), people, ["full_name", "pronoun"], strict=True)
    pair = M.evaluation_labels(F.col("persoon"), F.col("full_name"), F.col("pronoun"),
                               F.col("subreddit"), B.OFF_TOPIC)
    simple = M.about_labels(F.col("persoon"))
    return rows.select(
        "comment_id", pair[0].alias("about"), pair[1].alias("not_about"),
        simple[0].alias("about_simple"), simple[1].alias("not_about_simple"),
        M.pronoun(F.col("gender")).alias("pronoun_of_gender"))
