"""Scoring: rule scorers as plain columns, a trained classifier, and a hook for any batch model."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gabble import catalog
from gabble.functions import rules
from gabble.functions import text as T
from gabble.operators.match import with_variants

#: Scores a batch: texts and the candidate labels of each -> (best label, score) of each.
BatchScorer = Callable[[list[str], list[list[str]]], Sequence[tuple[str, float]]]


def lexicon_sentiment(df: DataFrame, text: str = "comment",
                      negative: Iterable[str] = catalog.NEGATIVE_WORDS,
                      positive: Iterable[str] = catalog.POSITIVE_WORDS) -> DataFrame:
    """Add ``negative``, ``sentiment_label`` and ``sentiment_score`` from two word lists.

    The label is the side with more hits, ``neutral`` on a tie; the score is the larger side's
    smoothed share of all hits. Missing text gives nulls, the same as a failing model.
    """
    return (
        df.withColumns({"_neg": T.count_words(F.col(text), negative),
                        "_pos": T.count_words(F.col(text), positive)})
        .withColumn("sentiment_label",
                    F.when(F.col("_neg") > F.col("_pos"), "negative")
                    .when(F.col("_pos") > F.col("_neg"), "positive")
                    .when(F.col("_neg").isNotNull(), "neutral"))
        .withColumns({
            "negative": F.col("sentiment_label") == "negative",
            "sentiment_score": rules.rounded(
                (F.greatest("_neg", "_pos") + 1) / (F.col("_neg") + F.col("_pos") + 1)),
        })
        .drop("_neg", "_pos")
    )


def negative_flag(df: DataFrame, text: str = "comment",
                  negative: Iterable[str] = catalog.NEGATIVE_WORDS) -> DataFrame:
    """Add ``sentiment``: ``negative`` where a word of the list occurs, else ``neutral``."""
    return df.withColumn(
        "sentiment", F.when(T.has_word(F.col(text), negative), "negative")
        .when(F.col(text).isNotNull(), "neutral"))


def relevance(df: DataFrame, entities: DataFrame,
              off_topic: Iterable[str] = catalog.OFF_TOPIC_SUBREDDITS) -> DataFrame:
    """Add ``label``, ``confidence`` and ``reason`` by naming rules.

    A comment is relevant when it names the person, or when its thread title does. In off-topic
    subreddits only the full name inside the comment counts.
    """
    comment, title = T.fold(F.col("comment")), T.fold(F.col("thread_title"))
    named = T.contains_any(comment, F.col("strict_variants"))
    full = T.contains_any(comment, F.col("title_variants"))
    thread = T.contains_any(title, F.col("title_variants"))
    case = (
        F.when(T.member(F.col("subreddit"), off_topic),
               F.when(full, "full name in comment").otherwise("off-topic subreddit"))
        .when(named, "named in comment")
        .when(thread, "thread about person")
        .otherwise("not named")
    )
    columns = ["strict_variants", "title_variants"]
    return (
        with_variants(df, entities, columns, T.fold)
        .withColumn("reason", case)
        .drop(*columns)
        .withColumns({
            "label": F.when(F.col("reason").isin("off-topic subreddit", "not named"),
                            "NOT_RELEVANT").otherwise("RELEVANT"),
            "confidence": F.when(F.col("reason").isin("full name in comment", "named in comment"),
                                 "high")
            .when(F.col("reason") == "thread about person", "medium").otherwise("low"),
        })
    )


def three_flags(df: DataFrame, text: str = "comment",
                skating: Iterable[str] = catalog.SKATING_WORDS,
                performance: Iterable[str] = catalog.PERFORMANCE_WORDS,
                negative: Iterable[str] = catalog.NEGATIVE_WORDS) -> DataFrame:
    """Add nullable booleans ``speedskating``, ``performance``, ``negative``; null without text."""
    source = F.when(T.strip(F.col(text)) != "", F.col(text))
    return df.withColumns({
        "speedskating": T.has_word(source, skating),
        "performance": T.has_word(source, performance),
        "negative": T.has_word(source, negative),
    })


class DeadModel(RuntimeError):
    """A model failed on every row of a batch."""


#: Rows in a batch from which on the failure of all of them means that the model is dead.
_DEAD_ROWS = 10


def _each_row(call: Callable[..., list], *columns: list, attempts: int = 1) -> list[tuple]:
    """(result, error) of each row: the batch at once, or when it fails each row on its own."""
    n = len(columns[0])
    try:
        results = list(call(*columns))
        if len(results) != n:
            raise ValueError(f"{len(results)} results for {n} rows")
        return [(r, None) for r in results]
    except Exception:
        out = []
        for row in zip(*columns):
            for attempt in range(attempts):
                try:
                    out.append((list(call(*[[v] for v in row]))[0], None))
                    break
                except Exception as error:
                    if attempt == attempts - 1:
                        out.append((None, f"{type(error).__name__}: {error}"))
        if n >= _DEAD_ROWS and all(error for _, error in out):
            raise DeadModel(f"the model failed on all {n} rows of a batch, first: {out[0][1]}")
        return out


def batch_score(df: DataFrame, load: Callable[[], BatchScorer], keys: Sequence[str],
                text: str = "comment", labels: str = "candidate_labels") -> DataFrame:
    """Run a model over ``keys, text, labels``: ``keys, best_label, model_score, error``.

    ``load`` builds the model once per task. Only the needed columns cross into Python; missing text
    is scored as the empty string. A row the model fails on gets null label and score with the cause
    as ``error``, and the job goes on; a model that fails on a whole batch stops it. Spark may run a
    task again, so write the result once and read it back for reports.
    """
    narrow = df.select(*keys, T.filled(F.col(text)).alias("_text"),
                       F.col(labels).alias("_labels"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    key_names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in batches:
            scored = _each_row(scorer, batch["_text"].tolist(), [list(c) for c in batch["_labels"]])
            out = batch[key_names].copy()
            out["best_label"] = [r[0] if r else None for r, _ in scored]
            out["model_score"] = pd.array([r[1] if r else None for r, _ in scored], dtype="Float64")
            out["error"] = [error for _, error in scored]
            yield out

    return narrow.mapInPandas(run, f"{fields}, best_label string, model_score double, error string")


def batch_answer(df: DataFrame, load: Callable[[], Callable[[list[str]], Sequence[str]]], keys: Sequence[str],
                 prompt: str = "prompt", attempts: int = 2) -> DataFrame:
    """Run a text model over ``keys, prompt``: ``keys, response, error``.

    The model gets a batch of prompts and returns a text for each. When a batch fails, each prompt is
    tried on its own, ``attempts`` times; what still fails has a null response and the cause as
    ``error``. A model that fails on a whole batch stops the job.
    """
    narrow = df.select(*keys, T.filled(F.col(prompt)).alias("_prompt"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    key_names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            answers = _each_row(model, batch["_prompt"].tolist(), attempts=attempts)
            out = batch[key_names].copy()
            out["response"] = [r for r, _ in answers]
            out["error"] = [error for _, error in answers]
            yield out

    return narrow.mapInPandas(run, f"{fields}, response string, error string")


def word_odds(labelled: DataFrame, text: str = "comment", target: str = "target") -> DataFrame:
    """``word, n_docs, n_positive, idf, log_odds``: how words tell the classes apart.

    ``n_docs`` and ``n_positive`` count the texts with the word; the odds are smoothed by one text.
    """
    rows = labelled.select(F.col(text).alias("text"), (F.col(target) > 0).cast("bigint").alias("positive"))
    totals = rows.agg(F.struct(F.count("*").alias("n"), F.sum("positive").alias("p"))).scalar()
    counts = (rows.select("positive", F.explode(_distinct_words("text")).alias("word"))
              .groupBy("word").agg(F.count("*").alias("n_docs"), F.sum("positive").alias("n_positive")))
    n, p = F.col("t")["n"], F.col("t")["p"]
    with_word = F.ln((F.col("n_positive") + 1) / (p + 2))
    without = F.ln((F.col("n_docs") - F.col("n_positive") + 1) / (n - p + 2))
    return counts.withColumn("t", totals).select(
        "word", "n_docs", "n_positive", F.ln((n + 1) / (F.col("n_docs") + 1)).alias("idf"),
        (with_word - without).alias("log_odds"))


def apply_word_odds(df: DataFrame, odds: DataFrame, keys: Sequence[str], text: str = "comment",
                    prior: float = 0.0) -> DataFrame:
    """``keys, log_odds, prediction``: summed odds of a text's distinct words, 1 if above zero."""
    words = df.select(*keys, F.explode_outer(_distinct_words(text)).alias("word"))
    summed = words.join(odds.select("word", "log_odds"), "word", "left").groupBy(*keys).agg(
        (F.coalesce(F.sum("log_odds"), F.lit(0.0)) + prior).alias("log_odds"))
    return summed.withColumn("prediction", (F.col("log_odds") > 0).cast("int"))


def _distinct_words(text: str):
    return F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def train_classifier(labelled: DataFrame, text: str = "comment", target: str = "target",
                     features: int = 1 << 16) -> PipelineModel:
    """Fit a logistic regression on hashed, idf-weighted words. ``target`` is numeric.

    The word counts are kept while both fits read them; the texts are tokenised once.
    """
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features)
    counted = counts.transform(words.transform(labelled.select(text, target))).select(
        "_tf", target).persist()
    try:
        weights = IDF(inputCol="_tf", outputCol="_features").fit(counted)
        regression = LogisticRegression(
            featuresCol="_features", labelCol=target, maxIter=20, regParam=0.01,
            rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction",
        ).fit(weights.transform(counted))
    finally:
        counted.unpersist()
    return PipelineModel(stages=[words, counts, weights, regression])


def apply_classifier(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``prediction`` and ``model_score``, the probability of the predicted class."""
    return (
        model.transform(df)
        .withColumns({
            "prediction": F.col("_prediction").cast("int"),
            "model_score": rules.rounded(F.array_max(vector_to_array("_probability"))),
        })
        .drop("_words", "_tf", "_features", "_raw", "_probability", "_prediction")
    )
