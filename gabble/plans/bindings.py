"""The given tables seen as threads, comments, persons and earlier results.

Every view exists twice: as a DataFrame here and as SQL text for the check engine. The views add
rows and columns; none of them leaves out a row of its table, and each carries the whole text (as
comment or as title; a comment's thread title is a column more, made of its first line).

``documents`` are long comments, ``events`` are short notes carrying the edge cases of cleaning
(deleted markers, footers, bots, missing text, control characters, floods of copies),
``conversations`` are threads (turn 0) with their comments, ``labels`` are earlier results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gabble.catalog import Entity

#: Persons of the bound tables. Their variants are fragments that occur in the texts.
PEOPLE = tuple(
    Entity(f"p{i}", f"Person {title}", f"Person {title} (bound test person)",
           "man" if i % 2 == 0 else "vrouw", "he/him" if i % 2 == 0 else "she/her",
           (title, other), (title,), (title, other), (title,))
    for i, (title, other) in enumerate([
        ("Thing", "thre"), ("ring", "erly"), ("ment", "elle"), ("keit", "ung"),
        ("ción", "ado"), ("Réleou", "éaux"),
    ])
)

ALLOWLIST = tuple(f"src{i}" for i in range(10))
GENERAL = ("src0", "src1", "src2")
OFF_TOPIC = ("src3", "src13")
BOTS = ("AutoModerator", "[deleted]", "u0", "u1")
NEGATIVE = ("trash", "clown", "idiot", "scum", "worthless", "moron", "pathetic", "loser",
            "disgusting", "stupid")
POSITIVE = ("and", "est", "und", "el")
SKATING = ("the", "le", "der", "la")
PERFORMANCE = ("with", "dans", "mit", "con")
SENTIMENTS = ("negative", "neutral", "positive")

#: Order value of the first note: notes come after all comments.
_NOTES_AFTER = 10**15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as comments; copies of a text share person, author and thread."""
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('https://www.reddit.com/r/', source, '/d', doc_id) AS url",
        "concat('u', n_chars % 50) AS author",
        "cast(date_add(date'2023-11-14', cast(doc_id % 400 AS int)) AS string) AS date",
        "1699920000 + (doc_id % 400) * 86400 AS timestamp",
        "doc_id % 97 AS score",
        "doc_id % 97 AS upvotes",
        "0L AS downvotes",
        "0L AS golds",
        "text AS comment",
        "concat('d', doc_id) AS comment_id",
        "concat('/t/', n_chars % 200) AS thread_url",
        "split_part(text, '\n', 1) AS thread_title",
        "source AS subreddit",
        "concat('p', n_chars % 6) AS persoon",
        "if(n_chars % 2 = 0, 'man', 'vrouw') AS gender",
        "concat('t', n_chars % 200) AS thread_id",
        "doc_id AS ingest_order",
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as short comments in the same columns."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('https://www.reddit.com/r/src', user_id % 20, '/e', event_id) AS url",
        """CASE event_id % 7 WHEN 0 THEN 'AutoModerator' WHEN 1 THEN '[deleted]'
           WHEN 2 THEN 'AUTOMODERATOR' WHEN 3 THEN NULL
           ELSE concat('u', user_id % 50) END AS author""",
        "date_format(ts, 'yyyy-MM-dd') AS date",
        "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts) AS timestamp",
        "event_id % 97 AS score",
        "event_id % 97 AS upvotes",
        "0L AS downvotes",
        "0L AS golds",
        r"""CASE event_id % 12 WHEN 0 THEN '[deleted]' WHEN 1 THEN 'x [removed] y'
           WHEN 2 THEN 'THIS POST WAS MASS DELETED by tool'
           WHEN 3 THEN concat('good ', event_type, '\n\n*This post was mass deleted with a tool*')
           WHEN 4 THEN '  Deleted ' WHEN 5 THEN '.' WHEN 6 THEN '' WHEN 7 THEN NULL
           WHEN 8 THEN concat('  \t padded ', event_type, '  ')
           WHEN 9 THEN concat('ctrl', chr(1), chr(7), event_type, '\tend')
           WHEN 10 THEN props
           ELSE concat('Something about ', event_type, ' by ', user_id) END AS comment""",
        "concat('e', event_id) AS comment_id",
        "concat('/t/', user_id % 200) AS thread_url",
        "concat('Ring of ', event_type) AS thread_title",
        "concat('src', user_id % 20) AS subreddit",
        "concat('p', user_id % 6) AS persoon",
        "if(user_id % 2 = 0, 'man', 'vrouw') AS gender",
        "concat('t', user_id % 200) AS thread_id",
        f"{_NOTES_AFTER} + event_id AS ingest_order",
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything collected, before cleaning."""
    return comments(spark, sf_dir).unionByName(notes(spark, sf_dir))


def manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as hand labels of documents, keyed like their comments."""
    labels = table(spark, sf_dir, "labels").selectExpr(
        "doc_id",
        """CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
           ELSE 'neutral' END AS sentiment""",
    )
    keys = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat('d', doc_id) AS comment_id", "concat('p', n_chars % 6) AS persoon")
    return keys.join(labels, "doc_id").select("comment_id", "persoon", "sentiment")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments with their hand label where there is one, and flags derived from it."""
    return comments(spark, sf_dir).join(
        manual(spark, sf_dir), ["comment_id", "persoon"], "left").selectExpr(
        "*", "sentiment = 'negative' AS negative")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns of ``conversations`` as threads."""
    return table(spark, sf_dir, "conversations").filter("turn = 0").selectExpr(
        "concat('c', conv_id) AS thread_id",
        "concat('https://www.reddit.com/r/src', conv_id % 20, '/c', conv_id) AS url",
        "text AS title",
        "concat('src', conv_id % 20) AS subreddit",
        "cast(length(text) AS bigint) AS score",
    )


def thread_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later turns of ``conversations`` as comments of their thread."""
    return table(spark, sf_dir, "conversations").filter("turn > 0").selectExpr(
        "concat('c', conv_id) AS thread_id",
        "concat('c', conv_id, '_', turn) AS comment_id",
        "role AS author",
        "text AS comment",
    )


def found_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as search results: each text is one thread listed for its person, by two
    searches (the second one lists it with another score)."""
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('p', n_chars % 6) AS persoon", "concat('t', doc_id) AS thread_id",
        "text AS title", "source AS subreddit",
        "inline(array(struct(0 AS query_index, doc_id % 97 AS score),"
        "struct(1 AS query_index, doc_id % 89 AS score)))",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled ``documents`` as model answers in all the shapes a parser meets; the whole text is
    the reason that the answer gives."""
    labels = table(spark, sf_dir, "labels")
    texts = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "to_json(named_struct('t', text)) AS quoted")
    return labels.join(texts, "doc_id").selectExpr(
        "doc_id",
        r"""CASE doc_id % 8
           WHEN 0 THEN concat('{"label": "relevant ", "confidence": "HIGH", "reason": ', substr(quoted, 6))
           WHEN 1 THEN '```json\n{"label": "NOT_RELEVANT", "confidence": "low"}\n```'
           WHEN 2 THEN 'Sure: {"label": "RELEVANT", "confidence": 0.5, "reason": null} ok'
           WHEN 3 THEN '{"label": "MAYBE", "confidence": "low"}'
           WHEN 4 THEN concat('no json for ', quoted, doc_id)
           WHEN 5 THEN 'Answer: {"a": {"b": 1}}'
           WHEN 6 THEN '12'
           ELSE ' {"speedskating": true, "performance": true, "negative": false} ' END AS response""",
        "quality", "toxic",
    )


# --- The same views for the check engine ----------------------------------------------------------

_PEOPLE_ROWS = ", ".join(
    "('{0}', '{1}', '{2}', '{3}', '{4}', [{5}], [{6}], [{7}], [{8}])".format(
        e.persoon, e.full_name, e.description, e.gender, e.pronoun,
        *[", ".join(f"'{v}'" for v in part) for part in
          (e.search_queries, e.title_variants, e.strict_variants, e.loose_variants)])
    for e in PEOPLE)

_FOLD = "translate(lower({0}), 'üöäéèë', 'uoaeee')"


def fold_sql(expression: str) -> str:
    return _FOLD.format(expression)


def round_sql(expression: str, digits: int) -> str:
    """Half-up rounding on the decimal value, as the engine rounds doubles."""
    return f"CAST(round(CAST({expression} AS DECIMAL(30, 14)), {digits}) AS DOUBLE)"


def in_sql(names) -> str:
    """Quoted list for ``IN (…)``."""
    return ", ".join(f"'{n}'" for n in names)


SQL_VIEWS = {
    "people": ((), f"""SELECT * FROM (VALUES {_PEOPLE_ROWS}) AS v(persoon, full_name, description,
        gender, pronoun, search_queries, title_variants, strict_variants, loose_variants)"""),
    "comments": ((), """SELECT 'https://www.reddit.com/r/' || source || '/d' || doc_id AS url,
        'u' || (n_chars % 50) AS author,
        CAST(CAST(DATE '2023-11-14' + CAST(doc_id % 400 AS INTEGER) AS DATE) AS VARCHAR) AS date,
        1699920000 + (doc_id % 400) * 86400 AS timestamp,
        doc_id % 97 AS score, doc_id % 97 AS upvotes,
        CAST(0 AS BIGINT) AS downvotes, CAST(0 AS BIGINT) AS golds,
        text AS comment, 'd' || doc_id AS comment_id,
        '/t/' || (n_chars % 200) AS thread_url, split_part(text, chr(10), 1) AS thread_title,
        source AS subreddit, 'p' || (n_chars % 6) AS persoon,
        CASE WHEN n_chars % 2 = 0 THEN 'man' ELSE 'vrouw' END AS gender,
        't' || (n_chars % 200) AS thread_id, doc_id AS ingest_order FROM documents"""),
    "notes": ((), f"""SELECT 'https://www.reddit.com/r/src' || (user_id % 20) || '/e' || event_id AS url,
        CASE event_id % 7 WHEN 0 THEN 'AutoModerator' WHEN 1 THEN '[deleted]'
          WHEN 2 THEN 'AUTOMODERATOR' WHEN 3 THEN NULL ELSE 'u' || (user_id % 50) END AS author,
        strftime(ts, '%Y-%m-%d') AS date,
        CAST(floor(epoch(ts)) AS BIGINT) AS timestamp,
        event_id % 97 AS score, event_id % 97 AS upvotes,
        CAST(0 AS BIGINT) AS downvotes, CAST(0 AS BIGINT) AS golds,
        CASE event_id % 12 WHEN 0 THEN '[deleted]' WHEN 1 THEN 'x [removed] y'
          WHEN 2 THEN 'THIS POST WAS MASS DELETED by tool'
          WHEN 3 THEN 'good ' || event_type || chr(10) || chr(10)
            || '*This post was mass deleted with a tool*'
          WHEN 4 THEN '  Deleted ' WHEN 5 THEN '.' WHEN 6 THEN '' WHEN 7 THEN NULL
          WHEN 8 THEN chr(160) || ' ' || chr(9) || ' padded ' || event_type || ' ' || chr(160)
          WHEN 9 THEN 'ctrl' || chr(1) || chr(7) || event_type || chr(9) || 'end'
          WHEN 10 THEN props
          ELSE 'Something about ' || event_type || ' by ' || user_id END AS comment,
        'e' || event_id AS comment_id, '/t/' || (user_id % 200) AS thread_url,
        'Ring of ' || event_type AS thread_title, 'src' || (user_id % 20) AS subreddit,
        'p' || (user_id % 6) AS persoon,
        CASE WHEN user_id % 2 = 0 THEN 'man' ELSE 'vrouw' END AS gender,
        't' || (user_id % 200) AS thread_id, {_NOTES_AFTER} + event_id AS ingest_order
        FROM events"""),
    "raw": (("comments", "notes"), "SELECT * FROM comments UNION ALL SELECT * FROM notes"),
    "manual": ((), """SELECT 'd' || doc_id AS comment_id, 'p' || (n_chars % 6) AS persoon,
        CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
          ELSE 'neutral' END AS sentiment FROM documents JOIN labels USING (doc_id)"""),
    "scored": (("comments", "manual"), """SELECT comments.*, sentiment,
        sentiment = 'negative' AS negative
        FROM comments LEFT JOIN manual USING (comment_id, persoon)"""),
    "threads": ((), """SELECT 'c' || conv_id AS thread_id,
        'https://www.reddit.com/r/src' || (conv_id % 20) || '/c' || conv_id AS url,
        text AS title, 'src' || (conv_id % 20) AS subreddit,
        CAST(length(text) AS BIGINT) AS score FROM conversations WHERE turn = 0"""),
    "thread_comments": ((), """SELECT 'c' || conv_id AS thread_id,
        'c' || conv_id || '_' || turn AS comment_id, role AS author, text AS comment
        FROM conversations WHERE turn > 0"""),
    "found_threads": ((), """SELECT 'p' || (n_chars % 6) AS persoon, 't' || doc_id AS thread_id,
        text AS title, source AS subreddit, query_index,
        CASE query_index WHEN 0 THEN doc_id % 97 ELSE doc_id % 89 END AS score
        FROM documents, (VALUES (0), (1)) AS q(query_index)"""),
    "responses": ((), r"""SELECT doc_id, quality, toxic, CASE doc_id % 8
        WHEN 0 THEN '{"label": "relevant ", "confidence": "HIGH", "reason": ' || CAST(to_json(text) AS VARCHAR) || '}'
        WHEN 1 THEN '```json' || chr(10) || '{"label": "NOT_RELEVANT", "confidence": "low"}' || chr(10) || '```'
        WHEN 2 THEN 'Sure: {"label": "RELEVANT", "confidence": 0.5, "reason": null} ok'
        WHEN 3 THEN '{"label": "MAYBE", "confidence": "low"}'
        WHEN 4 THEN 'no json for {"t":' || CAST(to_json(text) AS VARCHAR) || '}' || doc_id
        WHEN 5 THEN 'Answer: {"a": {"b": 1}}'
        WHEN 6 THEN '12'
        ELSE ' {"speedskating": true, "performance": true, "negative": false} ' END AS response
        FROM labels JOIN documents USING (doc_id)"""),
    "parsed": (("responses",), r"""SELECT *, CASE
          WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'OBJECT' THEN t END
          WHEN json_valid(block) THEN CASE WHEN json_type(block) = 'OBJECT' THEN block END END AS obj
        FROM (SELECT *, trim(response, ' ' || chr(10)) AS t,
            nullif(regexp_extract(response, '\{.*?\}', 0, 's'), '') AS block FROM responses)"""),
}


def sql(body: str, *views: str) -> str:
    """A check query with the views it names defined in front of it."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for inner in SQL_VIEWS[name][0]:
            need(inner)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        need(view)
    heads = [f"{name} AS ({SQL_VIEWS[name][1]})" for name in ordered]
    if not heads:
        return body
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(heads)}, {body[5:]}"
    return f"WITH {', '.join(heads)} {body}"
