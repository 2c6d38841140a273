"""Queries: model answers, decision rules, scorers, join-back and resume."""

from pyspark.sql import functions as F

from gabble.catalog import RELEVANCE_LABELS, entity_frame
from gabble.functions import modeltext as M
from gabble.functions import rules
from gabble.operators import linear, match, report, resume, score
from gabble.operators.select import last_per_key
from gabble.plans import bindings as B
from gabble.plans.bindings import in_sql, round_sql, sql
from gabble.plans.queries_clean import hit_folded
from gabble.plans.registry import query

def _member_sql(name: str) -> str:
    """A member as text: absent is empty, a JSON null is ``None``."""
    return (f"CASE WHEN json_type(obj, '$.{name}') IS NULL THEN '' WHEN json_type(obj, '$.{name}') = 'NULL' "
            f"THEN 'None' ELSE json_extract_string(obj, '$.{name}') END")


@query(sql("""SELECT doc_id, json_extract_string(obj, '$.label') AS label, obj IS NOT NULL AS readable
  FROM parsed""", "parsed"))
def json_parse_label(spark, d):
    parsed = B.responses(spark, d).withColumn("obj", M.first_object(F.col("response")))
    return parsed.select("doc_id", F.try_variant_get("obj", "$.label", "string").alias("label"),
                         F.col("obj").isNotNull().alias("readable"))


@query(sql(r"""SELECT doc_id, CAST(json_extract_string(b, '$.speedskating') AS BOOLEAN) AS speedskating,
  CAST(json_extract_string(b, '$.performance') AS BOOLEAN) AS performance,
  CAST(json_extract_string(b, '$.negative') AS BOOLEAN) AS negative
  FROM (SELECT doc_id, CASE WHEN json_valid(b) THEN b END AS b
    FROM (SELECT doc_id, regexp_extract(response, '\{.*\}', 0, 's') AS b FROM responses))""", "responses"))
def json_parse_flags(spark, d):
    return B.responses(spark, d).select("doc_id", M.flags_answer(F.col("response")).alias("f")) \
        .select("doc_id", "f.*")


@query(sql(f"""SELECT doc_id, CASE WHEN good THEN label ELSE 'ERROR' END AS label,
  CASE WHEN good THEN lower(confidence) ELSE '' END AS confidence,
  CASE WHEN good THEN reason WHEN obj IS NULL THEN 'parse_fail: Could not parse JSON from: ' || t
    ELSE 'parse_fail: Bad label: ' || chr(39) || label || chr(39) END AS reason,
  CASE WHEN good THEN response ELSE '' END AS raw
  FROM (SELECT *, coalesce(label IN ({in_sql(RELEVANCE_LABELS)}), false) AS good
    FROM (SELECT *, trim(upper({_member_sql('label')})) AS label,
        {_member_sql('confidence')} AS confidence, {_member_sql('reason')} AS reason FROM parsed))""", "parsed"))
def validate_label(spark, d):
    return B.responses(spark, d).select(
        "doc_id", M.relevance_answer(F.col("response")).alias("a")
    ).select("doc_id", "a.label", "a.confidence", "a.reason", "a.raw")


_SCORE_SQL = "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 0.5 + (doc_id % 100) / 1000.0 END"
_BEST_SQL = """CASE WHEN doc_id % 2 = 0 THEN 'this comment evaluates or describes ' || source
  ELSE 'this comment is not about ' || source || ' or contains no evaluation' END"""
_BEST_SIMPLE_SQL = """CASE WHEN doc_id % 2 = 0 THEN 'this comment is about ' || source
  || ' as an athlete or person' ELSE 'this comment is not about ' || source END"""


def _judged(spark, d):
    """Documents with a stand-in score that crosses the threshold and is missing at times."""
    return B.table(spark, d, "documents").selectExpr(
        "doc_id",
        "CASE WHEN doc_id % 11 <> 0 THEN cast(0.5 + (doc_id % 100) / 1000 AS double) END AS score",
        f"{_BEST_SQL} AS best", f"{_BEST_SIMPLE_SQL} AS best_simple")


@query(f"""SELECT doc_id, CASE WHEN score IS NULL THEN 'unknown' WHEN score < 0.55 THEN 'unclear'
    WHEN best LIKE '%evaluates or describes%' THEN 'relevant' ELSE 'not_relevant' END AS relevance
  FROM (SELECT doc_id, CAST({_SCORE_SQL} AS DOUBLE) AS score, {_BEST_SQL} AS best FROM documents)""")
def rule_threshold_4way(spark, d):
    return _judged(spark, d).select(
        "doc_id", rules.relevance_four_way(F.col("best"), F.col("score")).alias("relevance"))


@query(f"""SELECT doc_id, CASE WHEN score IS NULL THEN 'ERROR' WHEN score < 0.55 THEN 'NOT_RELEVANT'
    WHEN best LIKE 'this comment is about%' THEN 'RELEVANT' ELSE 'NOT_RELEVANT' END AS label,
  {round_sql('score', 4)} AS model_score
  FROM (SELECT doc_id, CAST({_SCORE_SQL} AS DOUBLE) AS score, {_BEST_SIMPLE_SQL} AS best
    FROM documents)""")
def rule_threshold_2way(spark, d):
    best, value = F.col("best_simple"), F.col("score")
    return _judged(spark, d).select(
        "doc_id", rules.relevance_two_way(best, value).alias("label"),
        rules.rounded(value).alias("model_score"))


def _count_sql(words) -> str:
    return ("len(list_filter(string_split_regex(lower(comment), '[^\\p{L}\\p{N}_]+'), "
            f"lambda w: w IN ({in_sql(words)})))")


def has_word_sql(words) -> str:
    return (r"regexp_matches(lower(comment), '(^|[^\p{L}\p{N}_])(" + "|".join(words)
            + r")($|[^\p{L}\p{N}_])')")


@query(sql(f"""SELECT comment_id, label AS sentiment_label, label = 'negative' AS negative,
  {round_sql('(greatest(neg, pos) + 1.0) / (neg + pos + 1)', 4)} AS sentiment_score
  FROM (SELECT comment_id, neg, pos, CASE WHEN neg > pos THEN 'negative'
      WHEN pos > neg THEN 'positive' WHEN neg IS NOT NULL THEN 'neutral' END AS label
    FROM (SELECT comment_id, {_count_sql(B.NEGATIVE)} AS neg, {_count_sql(B.POSITIVE)} AS pos
      FROM raw))""", "raw"))
def score_lexicon(spark, d):
    return score.lexicon_sentiment(
        B.raw(spark, d), negative=B.NEGATIVE, positive=B.POSITIVE
    ).select("comment_id", "sentiment_label", "negative", "sentiment_score")


_RELEVANCE_SQL = f"""SELECT comment_id, persoon, reason,
  CASE WHEN reason IN ('off-topic subreddit', 'not named') THEN 'NOT_RELEVANT'
    ELSE 'RELEVANT' END AS label,
  CASE WHEN reason IN ('full name in comment', 'named in comment') THEN 'high'
    WHEN reason = 'thread about person' THEN 'medium' ELSE 'low' END AS confidence
  FROM (SELECT comment_id, c.persoon, CASE WHEN subreddit IN ({in_sql(B.OFF_TOPIC)}) THEN
      CASE WHEN {hit_folded('comment', 'title_variants')} THEN 'full name in comment'
        ELSE 'off-topic subreddit' END
    WHEN {hit_folded('comment', 'strict_variants')} THEN 'named in comment'
    WHEN {hit_folded('thread_title', 'title_variants')} THEN 'thread about person'
    ELSE 'not named' END AS reason FROM comments c JOIN people USING (persoon))"""


def _relevance(spark, d):
    return score.relevance(B.comments(spark, d), entity_frame(spark, B.PEOPLE), B.OFF_TOPIC)


@query(sql(f"SELECT comment_id, label, confidence, reason FROM ({_RELEVANCE_SQL})",
           "comments", "people"))
def score_relevance_rule(spark, d):
    return _relevance(spark, d).select("comment_id", "label", "confidence", "reason")


_FLAGS_SQL = f"""SELECT comment_id, gender,
  CASE WHEN blank THEN NULL ELSE {has_word_sql(B.SKATING)} END AS speedskating,
  CASE WHEN blank THEN NULL ELSE {has_word_sql(B.PERFORMANCE)} END AS performance,
  CASE WHEN blank THEN NULL ELSE {has_word_sql(B.NEGATIVE)} END AS negative
  FROM (SELECT *, comment IS NULL OR comment = '' AS blank FROM raw)"""


def _flags(spark, d):
    return score.three_flags(B.raw(spark, d), skating=B.SKATING, performance=B.PERFORMANCE,
                             negative=B.NEGATIVE)


@query(sql(f"SELECT comment_id, speedskating, performance, negative FROM ({_FLAGS_SQL})", "raw"))
def score_three_flags(spark, d):
    return _flags(spark, d).select("comment_id", "speedskating", "performance", "negative")


@query(sql(f"SELECT comment_id, gender FROM ({_FLAGS_SQL}) "
           "WHERE speedskating AND performance AND negative", "raw"))
def filter_three_flags(spark, d):
    return report.filter_flags(
        _flags(spark, d), ["speedskating", "performance", "negative"]
    ).select("comment_id", "gender")


def load_keyword_model():
    """Batch model used for the check: names the first candidate for texts with a listed word.

    It refuses one kind of text, which exercises the handling of failing rows.
    """
    import re

    word = re.compile(r"(?<!\w)(?:" + "|".join(B.NEGATIVE) + r")(?!\w)")

    def score_batch(texts, labels):
        if "[deleted]" in texts:
            raise ValueError("deleted text")
        return [(c[0], 0.9) if word.search(t.lower()) else (c[1], 0.6)
                for t, c in zip(texts, labels)]

    return score_batch


@query(sql(f"""SELECT comment_id, persoon, CASE WHEN comment = '[deleted]' THEN NULL
    WHEN hit THEN 'this comment is about ' || persoon || ' as an athlete or person'
    ELSE 'this comment is not about ' || persoon END AS best_label,
  CASE WHEN comment = '[deleted]' THEN NULL WHEN hit THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END
    AS model_score
  FROM (SELECT *, coalesce({has_word_sql(B.NEGATIVE)}, false) AS hit FROM raw)""", "raw"))
def score_batch_hook(spark, d):
    rows = B.raw(spark, d).withColumn("candidate_labels", M.about_labels(F.col("persoon")))
    return score.batch_score(rows, load_keyword_model, ["comment_id", "persoon"]).drop("error")


@query(sql("""SELECT comment_id, persoon, coalesce(comment, '') = '[deleted]' AS failed,
  CASE WHEN comment = '[deleted]' THEN 'ValueError: deleted text' END AS error FROM raw""", "raw"))
def score_row_errors(spark, d):
    """What became of the rows that the model refused: the cause stays with the row, the others are scored."""
    rows = B.raw(spark, d).withColumn("candidate_labels", M.about_labels(F.col("persoon")))
    scored = score.batch_score(rows, load_keyword_model, ["comment_id", "persoon"])
    return scored.select("comment_id", "persoon", F.col("best_label").isNull().alias("failed"), "error")


def load_answering_model():
    """Text model used for the check: answers in JSON, quoting the comment's part of the prompt as its reason.

    It fails at times on a batch, so that prompts are tried one by one.
    """
    import json
    import re

    word = re.compile(r"(?<!\w)(?:" + "|".join(B.NEGATIVE) + r")(?!\w)")

    def answer(prompts):
        if len(prompts) > 1 and any("[deleted]" in p for p in prompts):
            raise ValueError("deleted text")
        return [json.dumps({"label": "RELEVANT" if word.search(p.lower()) else "not_relevant",
                            "confidence": "High", "reason": p.split("Comment: ", 1)[-1]}, ensure_ascii=False) for p in prompts]

    return answer


@query(sql(f"""SELECT comment_id, persoon, 'high' AS confidence, coalesce(comment, '') AS reason,
    CASE WHEN coalesce({has_word_sql(B.NEGATIVE)}, false) THEN 'RELEVANT' ELSE 'NOT_RELEVANT' END AS label
  FROM raw""", "raw"))
def score_batch_answer(spark, d):
    """Prompt, answer, parse and validate over whole comments."""
    rows = B.raw(spark, d).withColumn("prompt", F.concat(F.lit("Comment: "), F.coalesce("comment", F.lit(""))))
    answers = score.batch_answer(rows, load_answering_model, ["comment_id", "persoon"])
    return answers.withColumn("a", M.relevance_answer(F.col("response"))).select(
        "comment_id", "persoon", "a.label", "a.confidence", "a.reason")


_WORDS_SQL = """words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS word
    FROM documents),
  marked AS (SELECT doc_id, CAST(toxic > 0 AS BIGINT) AS positive FROM documents JOIN labels USING (doc_id)),
  totals AS (SELECT count(*) AS n, sum(positive) AS p FROM marked),
  counts AS (SELECT word, count(*) AS n_docs, CAST(sum(positive) AS BIGINT) AS n_positive
    FROM words JOIN marked USING (doc_id) GROUP BY word),
  odds AS (SELECT word, n_docs, n_positive, ln((n + 1) / (n_docs + 1)) AS idf,
      ln((n_positive + 1) / (p + 2)) - ln((n_docs - n_positive + 1) / (n - p + 2)) AS log_odds
    FROM counts, totals)"""


def _marked(spark, d):
    labels = B.table(spark, d, "labels").select("doc_id", F.col("toxic").alias("target"))
    return B.table(spark, d, "documents").select("doc_id", F.col("text").alias("comment")).join(labels, "doc_id")


@query(f"""WITH {_WORDS_SQL} SELECT word, n_docs, n_positive, round(idf, 6) AS idf, round(log_odds, 6) AS log_odds
  FROM odds""")
def score_word_odds(spark, d):
    return score.word_odds(_marked(spark, d)).select(
        "word", "n_docs", "n_positive", F.round("idf", 6).alias("idf"), F.round("log_odds", 6).alias("log_odds"))


@query(f"""WITH {_WORDS_SQL} SELECT doc_id, round(coalesce(sum(log_odds), 0), 4) AS log_odds,
    CAST(coalesce(sum(log_odds), 0) > 0 AS INTEGER) AS prediction
  FROM documents LEFT JOIN words USING (doc_id) LEFT JOIN odds USING (word) GROUP BY doc_id""")
def score_naive_bayes(spark, d):
    """The trained word classifier on every document."""
    odds = score.word_odds(_marked(spark, d))
    documents = B.table(spark, d, "documents").select("doc_id", F.col("text").alias("comment"))
    return score.apply_word_odds(documents, odds, ["doc_id"]).withColumn("log_odds", F.round("log_odds", 4))


def _trained_sql():
    """The training steps as one common table each."""
    table = f"""WITH words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS word
    FROM documents),
  pairs AS MATERIALIZED (SELECT DISTINCT doc_id, CAST('0x' || substr(md5(word), 1, 4) AS INTEGER) AS cell FROM words
    UNION ALL SELECT doc_id, {linear.FEATURES} FROM documents),
  sizes AS MATERIALIZED (SELECT doc_id, count(*) AS size FROM pairs GROUP BY doc_id),
  marked AS MATERIALIZED (SELECT doc_id, size, CAST(toxic > 0 AS INTEGER) AS y FROM sizes JOIN labels USING (doc_id)),
  w0 AS MATERIALIZED (SELECT cell, 0.0::DOUBLE AS weight, CASE WHEN cell = {linear.FEATURES} THEN 1.0::DOUBLE
      ELSE ln(((SELECT count(*) FROM marked) + 1) / (count(*) + 1)) END AS idf
    FROM pairs JOIN marked USING (doc_id) GROUP BY cell)"""
    for k in range(linear.STEPS):
        table += f""",
  p{k} AS MATERIALIZED (SELECT doc_id, any_value(size) AS size, any_value(y) AS y, 1 / (1 + exp(-sum(weight * idf) / sqrt(any_value(size)))) AS p
    FROM marked JOIN pairs USING (doc_id) JOIN w{k} USING (cell) GROUP BY doc_id),
  s{k} AS (SELECT cell, sum((p - y) / sqrt(size)) AS off, sum(p * (1 - p) / size) AS bend FROM p{k} JOIN pairs USING (doc_id) GROUP BY cell),
  w{k + 1} AS MATERIALIZED (SELECT cell, idf, weight - {linear.DAMP}::DOUBLE * (idf * off + {linear.RIDGE}::DOUBLE * weight)
    / (idf * idf * bend + {linear.DRAG}::DOUBLE) AS weight FROM w{k} JOIN s{k} USING (cell))"""
    return table + f""",
  scored AS (SELECT doc_id, 1 / (1 + exp(-coalesce(sum(weight * idf), 0) / sqrt(any_value(size)))) AS p
    FROM pairs JOIN sizes USING (doc_id) LEFT JOIN w{linear.STEPS} USING (cell) GROUP BY doc_id)
  SELECT doc_id, CAST(p >= 0.5 AS INTEGER) AS prediction, round(greatest(p, 1 - p), 4) AS model_score FROM scored"""


@query(_trained_sql())
def score_trained_lr(spark, d):
    """The classifier trained step by step on the labelled documents, on every document."""
    documents = B.table(spark, d, "documents").select("doc_id", F.col("text").alias("comment"))
    return linear.apply(documents, linear.train(_marked(spark, d)), ["doc_id"])


@query(sql(f"SELECT comment_id, persoon, reason FROM ({_RELEVANCE_SQL}) WHERE label = 'RELEVANT'",
           "comments", "people"))
def filter_relevant(spark, d):
    return report.filter_label(_relevance(spark, d), "label", "RELEVANT").select(
        "comment_id", "persoon", "reason")


@query(sql(f"""SELECT count(*) AS total, count(*) FILTER (WHERE label = 'RELEVANT') AS relevant,
  count(*) FILTER (WHERE label <> 'RELEVANT') AS filtered_out FROM ({_RELEVANCE_SQL})""",
           "comments", "people"))
def agg_funnel(spark, d):
    return report.funnel(_relevance(spark, d), F.col("label") == "RELEVANT")


# --- Join-back and resume -------------------------------------------------------------------------

@query(sql("""SELECT comment_id, persoon, subreddit, sentiment
  FROM comments LEFT JOIN manual USING (comment_id, persoon)""", "comments", "manual"))
def join_scores_left(spark, d):
    return resume.attach_scores(B.comments(spark, d), B.manual(spark, d)).select(
        "comment_id", "persoon", "subreddit", "sentiment")


@query(sql("SELECT comment_id, persoon, comment FROM comments ANTI JOIN manual "
           "USING (comment_id, persoon)", "comments", "manual"))
def join_resume_anti(spark, d):
    return resume.remaining(B.comments(spark, d), B.manual(spark, d)).select(
        "comment_id", "persoon", "comment")


@query(sql("SELECT comment_id, persoon, comment FROM comments SEMI JOIN manual "
           "USING (comment_id, persoon)", "comments", "manual"))
def join_scored_semi(spark, d):
    return resume.scored(B.comments(spark, d), B.manual(spark, d)).select(
        "comment_id", "persoon", "comment")


def _result_runs(spark, d):
    """Two runs of results per labelled comment: the hand label, then a later correction."""
    first = B.manual(spark, d).selectExpr("*", "0 AS run")
    second = B.manual(spark, d).selectExpr(
        "comment_id", "persoon",
        "if(sentiment = 'neutral', 'positive', sentiment) AS sentiment", "1 AS run")
    return resume.append_results(first, second)


_RUNS_SQL = """runs AS (SELECT *, 0 AS run FROM manual UNION ALL SELECT comment_id, persoon,
    CASE sentiment WHEN 'neutral' THEN 'positive' ELSE sentiment END, 1 FROM manual),
  latest AS (SELECT * FROM runs QUALIFY row_number() OVER (
    PARTITION BY comment_id, persoon ORDER BY run DESC) = 1)"""


@query(sql(f"WITH {_RUNS_SQL} SELECT comment_id, persoon, sentiment, run FROM latest", "manual"))
def dedupe_last(spark, d):
    return last_per_key(_result_runs(spark, d), resume.SCORE_KEY, "run").select(
        "comment_id", "persoon", "sentiment", "run")


@query(sql(f"""WITH {_RUNS_SQL} SELECT comment_id, persoon, gender, sentiment
  FROM comments LEFT JOIN latest USING (comment_id, persoon)""", "comments", "manual"))
def join_lookup_struct(spark, d):
    return resume.attach_latest(B.comments(spark, d), _result_runs(spark, d), "run").select(
        "comment_id", "persoon", "gender", "sentiment")


@query(sql("""SELECT comment_id, persoon FROM comments LEFT JOIN (
    SELECT comment_id, persoon, nullif(sentiment, 'neutral') AS sentiment FROM manual) saved
  USING (comment_id, persoon) WHERE sentiment IS NULL""", "comments", "manual"))
def join_resume_keyed(spark, d):
    saved = B.manual(spark, d).withColumn("sentiment", F.expr("nullif(sentiment, 'neutral')"))
    return resume.unlabelled(B.comments(spark, d), saved, "sentiment").select(
        "comment_id", "persoon")


@query(sql("""WITH c AS (
    SELECT comment_id, persoon, row_number() OVER (ORDER BY ingest_order) - 1 AS position FROM comments),
  s AS (SELECT label, row_number() OVER (ORDER BY ingest_order) - 1 AS position
    FROM (SELECT ingest_order, nullif(subreddit, 'src3') AS label FROM comments WHERE ingest_order % 3 <> 0)),
  joined AS (SELECT c.*, label FROM c LEFT JOIN s USING (position))
  SELECT comment_id, persoon, position, label, position >= (SELECT count(label) FROM joined) AS to_do FROM joined""", "comments"))
def join_resume_position(spark, d):
    comments = B.comments(spark, d)
    saved = comments.where("ingest_order % 3 <> 0").selectExpr("ingest_order AS line", "nullif(subreddit, 'src3') AS label")
    return resume.attach_by_position(comments, saved, "label", ["ingest_order"], ["line"]).select(
        "comment_id", "persoon", "position", "label", "to_do")


@query(sql("""SELECT comment_id, c.persoon, coalesce(description, c.persoon) AS description
  FROM comments c LEFT JOIN (SELECT * FROM people WHERE persoon <> 'p5') USING (persoon)""",
           "comments", "people"))
def join_entity_default(spark, d):
    return match.described(B.comments(spark, d), entity_frame(spark, B.PEOPLE[:5])).select(
        "comment_id", "persoon", "description")


@query(sql("""SELECT comment_id, persoon, sentiment, CAST(NULL AS VARCHAR) AS source FROM manual
  UNION ALL SELECT comment_id, persoon, NULL, 'new' FROM comments
    ANTI JOIN manual USING (comment_id, persoon)""", "comments", "manual"))
def union_done_new(spark, d):
    done = B.manual(spark, d)
    new = resume.remaining(B.comments(spark, d), done).select(
        "comment_id", "persoon", F.lit("new").alias("source"))
    return resume.append_results(done, new)
