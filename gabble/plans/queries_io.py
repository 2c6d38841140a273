"""Queries: sources, sinks and streams, as round trips of whole tables through the shared folder."""

from pyspark.sql import functions as F

from gabble.operators import score, select
from gabble.plans import bindings as B
from gabble.plans import flows
from gabble.plans.bindings import sql
from gabble.plans.queries_clean import hit_folded
from gabble.plans.queries_score import has_word_sql
from gabble.plans.registry import query
from gabble.session import scratch_dir
from gabble.sources import cursors, landed, schemas, sinks
from gabble.streaming import incremental

_PAGE = 100
_FIELDS = ", ".join(schemas.COMMENT_FIELDS)


def _land_json(df, spark, name, compression="none"):
    """Write one JSON document per row (column ``page``) and return the folder."""
    path = scratch_dir(spark, name)
    df.select("page").write.option("compression", compression).text(path)
    return path


@query(sql(f"SELECT {_FIELDS} FROM comments", "comments"))
def src_comments_csv(spark, d):
    """Files with two orders of their columns in one folder."""
    path = scratch_dir(spark, "comments-csv")
    half = F.pmod(F.xxhash64("comment_id"), F.lit(2)) == 0
    rows = B.comments(spark, d).select(*schemas.COMMENT_FIELDS)
    sinks.write_csv(rows.where(half), f"{path}/a")
    sinks.write_csv(rows.where(~half).select(*reversed(schemas.COMMENT_FIELDS)), f"{path}/b")
    return landed.read_comments(spark, f"{path}/*", "csv")


@query(sql("""SELECT persoon, query_index,
  'https://www.reddit.com/r/' || subreddit || '/' || thread_id AS url, title, subreddit,
  thread_id, score FROM found_threads""", "found_threads"))
def src_thread_listing(spark, d):
    # A page holds up to 100 children of one search, as the site returns them.
    listed = B.found_threads(spark, d).selectExpr(
        "persoon", "query_index", f"floor(cast(substr(thread_id, 2) AS bigint) / {_PAGE}) AS number",
        "named_struct('data', named_struct('permalink', concat('/r/', subreddit, '/', thread_id), "
        "'title', title, 'subreddit', subreddit, 'id', thread_id, 'score', score)) AS child")
    pages = listed.groupBy("persoon", "query_index", "number").agg(
        F.to_json(F.struct(
            "query_index", "persoon",
            F.struct(F.collect_list("child").alias("children"), F.lit("next").alias("after"))
            .alias("data"))).alias("page"))
    return landed.read_thread_listing(spark, _land_json(pages, spark, "listing"))


def _paged_search(spark, d):
    """Pages of the found threads with their cursors, in no order: some twice, some not landed."""
    pages = B.found_threads(spark, d).selectExpr(
        "persoon", "query_index", f"floor(cast(substr(thread_id, 2) AS bigint) / {_PAGE}) AS number",
        "named_struct('permalink', concat('/r/', subreddit, '/', thread_id), 'title', title, "
        "'subreddit', subreddit, 'id', thread_id, 'score', score) AS data",
        "cast(substr(thread_id, 2) AS bigint) AS at")
    pages = pages.groupBy("persoon", "query_index", "number").agg(
        F.sort_array(F.collect_list(F.struct("at", "data"))).alias("listed"))
    ends = B.found_threads(spark, d).groupBy("persoon", "query_index").agg(
        F.max(F.expr(f"floor(cast(substr(thread_id, 2) AS bigint) / {_PAGE})")).alias("end"))
    linked = pages.join(ends, ["persoon", "query_index"]).withColumns({
        "cursor": F.expr("if(number > 0, concat('n', number), NULL)"),
        "after": F.expr("if(number < end, concat('n', number + 1), NULL)")})
    gap = (F.col("number") % 10 == 7) & (F.col("query_index") == 1)
    times = F.array_repeat(F.lit(0), F.when(F.col("number") % 5 == 1, 2).otherwise(1))
    children = F.transform("listed", lambda t: F.struct(t["data"].alias("data")))
    return linked.where(~gap).withColumn("copy", F.explode(times)).select(F.to_json(F.struct(
        "query_index", "persoon", "cursor", F.struct(children.alias("children"), "after").alias("data"))).alias("page")
    )


def _recursive(body):
    return sql(body, "found_threads").replace("WITH ", "WITH RECURSIVE ", 1)


_PAGES_SQL = f"""listed AS (SELECT *, CAST(substr(thread_id, 2) AS BIGINT) AS pos,
      CAST(substr(thread_id, 2) AS BIGINT) // {_PAGE} AS number FROM found_threads),
    full_pages AS (SELECT persoon, query_index, number, count(*) AS n FROM listed GROUP BY persoon, query_index, number),
    linked AS (SELECT *, CASE WHEN number > 0 THEN 'n' || number END AS cursor,
      CASE WHEN number < max(number) OVER (PARTITION BY persoon, query_index) THEN 'n' || (number + 1) END AS after FROM full_pages),
    landed AS (SELECT * FROM linked WHERE NOT (number % 10 = 7 AND query_index = 1)),
    chain AS (SELECT persoon, query_index, number, after, n, 0 AS page, CAST(0 AS BIGINT) AS skip FROM landed WHERE cursor IS NULL
      UNION ALL SELECT l.persoon, l.query_index, l.number, l.after, l.n, c.page + 1, c.skip + c.n
      FROM chain c JOIN landed l ON l.persoon = c.persoon AND l.query_index = c.query_index AND l.cursor = c.after)"""


@query(_recursive(f"""WITH {_PAGES_SQL}
  SELECT t.persoon, t.query_index, t.thread_id, t.title, t.score, CAST(page AS BIGINT) AS page,
    CAST(skip + row_number() OVER (PARTITION BY t.persoon, t.query_index, t.number ORDER BY pos) - 1 AS BIGINT) AS listing_rank
  FROM listed t JOIN landed USING (persoon, query_index, number)
  LEFT JOIN chain c ON c.persoon = t.persoon AND c.query_index = t.query_index AND c.number = t.number"""))
def src_listing_order(spark, d):
    """Threads in the order of their search, from pages landed in any order."""
    return cursors.read_listing(spark, _land_json(_paged_search(spark, d), spark, "paged", "gzip")).select(
        "persoon", "query_index", "thread_id", "title", "score", "page", "listing_rank")


@query(_recursive(f"""WITH {_PAGES_SQL},
    firsts AS (SELECT persoon, query_index, CAST(NULL AS VARCHAR) AS cursor FROM landed),
    wanted AS (SELECT persoon, query_index, after AS cursor FROM landed WHERE after IS NOT NULL UNION SELECT * FROM firsts)
  SELECT w.persoon, w.query_index, w.cursor, 'missing' AS problem, CAST(0 AS BIGINT) AS n_landed
    FROM wanted w LEFT JOIN landed l ON l.persoon = w.persoon AND l.query_index = w.query_index
      AND l.cursor IS NOT DISTINCT FROM w.cursor WHERE l.number IS NULL
  UNION ALL SELECT persoon, query_index, cursor, 'repeated', 2 FROM landed WHERE number % 5 = 1
  UNION ALL SELECT persoon, query_index, cursor, 'unreachable', CASE WHEN number % 5 = 1 THEN 2 ELSE 1 END
    FROM landed ANTI JOIN chain USING (persoon, query_index, number)"""))
def src_listing_audit(spark, d):
    """What is missing, repeated or cut off among the landed pages."""
    return cursors.audit(landed.read_listing_pages(spark, _land_json(_paged_search(spark, d), spark, "paged", "gzip")))


@query(sql("""SELECT 'https://www.reddit.com/r/' || subreddit || '/' || thread_id AS url, title,
  subreddit, thread_id, '[deleted]' AS author FROM threads""", "threads"))
def src_thread_listing_flat(spark, d):
    listed = B.threads(spark, d).selectExpr(
        f"floor(cast(substr(thread_id, 2) AS bigint) / {_PAGE}) AS number",
        "named_struct('permalink', concat('/r/', subreddit, '/', thread_id), 'title', title, "
        "'subreddit', subreddit, 'id', thread_id, 'author', cast(NULL AS string)) AS post")
    pages = listed.groupBy("number").agg(
        F.to_json(F.struct(F.collect_list("post").alias("data"))).alias("page"))
    return landed.read_thread_listing_flat(spark, _land_json(pages, spark, "flat-listing"))


@query(sql("""SELECT coalesce(author, '[deleted]') AS author, comment, score, timestamp, comment_id,
  thread_id FROM raw WHERE comment <> '' AND comment NOT IN ('[deleted]', '[removed]')""", "raw"))
def src_comments_flat(spark, d):
    listed = B.raw(spark, d).selectExpr(
        f"floor(ingest_order / {_PAGE}) AS number",
        "named_struct('body', comment, 'author', author, 'score', score, 'created_utc', cast(timestamp AS double), "
        "'id', comment_id, 'link_id', concat('t3_', thread_id)) AS item")
    pages = listed.groupBy("number").agg(
        F.to_json(F.struct(F.collect_list("item").alias("data"))).alias("page"))
    return landed.read_comments_flat(spark, _land_json(pages, spark, "flat-comments"))


def _tree_documents(spark, d):
    """Conversations as thread documents, one each: every turn replies to the one before through a
    deleted comment, next to a ``more`` node."""
    turns = B.table(spark, d, "conversations").selectExpr(
        "conv_id", "turn",
        "to_json(named_struct('id', concat(conv_id, '_', turn), 'body', text, 'author', role, "
        "'permalink', concat('/c', conv_id, '/', turn), 'ups', turn, 'score', length(text), "
        "'created_utc', 1700000000 + turn)) AS fields")
    chain = """aggregate(reverse(turns), '""', (below, t) -> concat(
      '{"kind":"Listing","data":{"children":[{"kind":"more","data":{"id":"m","children":["x"]}},',
      '{"kind":"t1","data":{"id":"gone","body":"[deleted]","replies":{"kind":"Listing","data":',
      '{"children":[{"kind":"t1","data":', left(t.fields, length(t.fields) - 1), ',"replies":',
      below, '}}]}}}}]}}'))"""
    return (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "fields"))).alias("turns"))
        .selectExpr(f"""concat('[{{"data":{{"children":[{{"data":{{"id":"c', conv_id, '"}}}}]}}}},',
            {chain}, ']') AS page""")
    )


@query("""SELECT 'c' || conv_id AS thread_id, conv_id || '_' || turn AS comment_id,
  'https://www.reddit.com/c' || conv_id || '/' || turn AS url, role AS author, text AS comment,
  '2023-11-14' AS date, 1700000000 + turn AS timestamp, length(text) AS score, turn AS upvotes,
  CAST(0 AS BIGINT) AS downvotes, CAST(0 AS BIGINT) AS golds,
  CAST(2 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS depth
  FROM conversations""")
def src_comment_tree(spark, d):
    return landed.read_comment_trees(spark, _land_json(_tree_documents(spark, d), spark, "trees"))


@query(sql(f"""WITH listed AS (
    SELECT 'p' || (conv_id % 6) AS persoon, 'c' || conv_id AS thread_id, text AS title,
      'src' || (conv_id % 20) AS subreddit, length(text) + 7 AS score
    FROM conversations WHERE turn = 0),
  tiered AS (SELECT listed.*, gender, strict_variants,
      CASE WHEN {hit_folded('title', 'title_variants')} THEN 1 ELSE 2 END AS tier
    FROM listed JOIN people USING (persoon)),
  chosen AS (SELECT * FROM tiered)
  SELECT 'https://www.reddit.com/c' || conv_id || '/' || turn AS url, role AS author,
    '2023-11-14' AS date, 1700000000 + turn AS timestamp, length(text) AS score, turn AS upvotes,
    CAST(0 AS BIGINT) AS downvotes, CAST(0 AS BIGINT) AS golds, text AS comment,
    conv_id || '_' || turn AS comment_id,
    'https://www.reddit.com/r/' || subreddit || '/' || thread_id AS thread_url,
    title AS thread_title, subreddit, persoon, gender
  FROM conversations JOIN chosen ON thread_id = 'c' || conv_id
  WHERE tier = 1 OR {hit_folded('text', 'strict_variants')}""", "people"))
def collected_landed(spark, d):
    threads = B.table(spark, d, "conversations").filter("turn = 0").selectExpr(
        "concat('p', conv_id % 6) AS persoon", f"floor(conv_id / {_PAGE}) AS number",
        "conv_id", "text", "length(text) AS size",
        "inline(array(struct(0 AS query_index, 0 AS extra), struct(1 AS query_index, 7 AS extra)))")
    pages = threads.selectExpr(
        "persoon", "query_index", "number",
        "named_struct('data', named_struct('permalink', "
        "concat('/r/src', conv_id % 20, '/c', conv_id), 'title', text, 'subreddit', "
        "concat('src', conv_id % 20), 'id', concat('c', conv_id), 'score', size + extra)) AS child",
    ).groupBy("persoon", "query_index", "number").agg(
        F.to_json(F.struct("query_index", "persoon", F.struct(
            F.collect_list("child").alias("children")).alias("data"))).alias("page"))
    listing = landed.read_thread_listing(spark, _land_json(pages, spark, "search"))
    trees = landed.read_comment_trees(spark, _land_json(_tree_documents(spark, d), spark, "trees"))
    return flows.collect_comments(listing, trees, B.PEOPLE, None).select(
        *schemas.COMMENT_FIELDS)


@query(sql("""SELECT persoon, gender, subreddit, comment, '' AS manual_label, '' AS model_deberta,
  '' AS model_gpt, '' AS model_claude FROM comments
  QUALIFY row_number() OVER (
    PARTITION BY persoon ORDER BY md5('42|' || comment_id), comment_id) <= 10""", "comments"))
def src_label_sheet(spark, d):
    path = scratch_dir(spark, "label-sheet")
    sinks.export_sample(select.label_sheet(B.comments(spark, d)), path)
    return landed.read_label_sheet(spark, path)


@query(sql(f"SELECT {_FIELDS} FROM raw", "raw"))
def snk_roundtrip(spark, d):
    path = scratch_dir(spark, "comments")
    sinks.write_comments(B.raw(spark, d), path)
    return landed.read_comments(spark, path)


@query(sql(f"SELECT {_FIELDS} FROM raw", "raw"))
def snk_partitioned(spark, d):
    path = scratch_dir(spark, "persons")
    sinks.write_per_person(B.raw(spark, d).select(*schemas.COMMENT_FIELDS), path)
    return sinks.read_per_person(spark, path)


_SENTIMENT_SQL = f"CASE WHEN {has_word_sql(B.NEGATIVE)} THEN 'negative' ELSE 'neutral' END"


def _two_landings(spark, d, name):
    """Land the comments in two parts and run the given stream after each one."""
    source, sink, checkpoint = (scratch_dir(spark, f"{name}-{part}")
                                for part in ("in", "out", "progress"))
    rows = B.comments(spark, d).select("comment_id", "persoon", "comment")
    first = F.pmod(F.xxhash64("comment_id"), F.lit(2)) == 0
    return rows, first, source, sink, checkpoint


def _score(df):
    return score.negative_flag(df, negative=B.NEGATIVE).select("comment_id", "persoon", "sentiment")


@query(sql(f"SELECT comment_id, persoon, {_SENTIMENT_SQL} AS sentiment FROM comments", "comments"))
def stream_resumable_score(spark, d):
    rows, first, source, sink, checkpoint = _two_landings(spark, d, "resume")
    for part in (rows.filter(first), rows.filter(~first)):
        part.write.mode("append").parquet(source)
        stream = incremental.read_landed(spark, source, rows.schema)
        incremental.run_available(_score(stream), sink, checkpoint)
    return spark.read.parquet(sink)


@query(sql(f"SELECT comment_id, persoon, {_SENTIMENT_SQL} AS sentiment FROM comments", "comments"))
def stream_dedupe(spark, d):
    # The second landing repeats everything, so half of it was scored by the first run already.
    rows, first, source, sink, checkpoint = _two_landings(spark, d, "dedupe")
    for part in (rows.filter(first), rows):
        part.write.mode("append").parquet(source)
        stream = incremental.unique(incremental.read_landed(spark, source, rows.schema))
        incremental.run_available(_score(stream), sink, checkpoint)
    return spark.read.parquet(sink)
