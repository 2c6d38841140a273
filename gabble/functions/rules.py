"""Decision rules that turn a classifier's best label and score into the stored label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gabble import catalog

_ABOUT_PREFIX = "this comment is about"
_EVALUATES_PHRASE = "evaluates or describes"


def rounded(score: Column) -> Column:
    """Model score to four decimals."""
    return F.round(score, 4)


def relevance_four_way(best_label: Column, score: Column,
                       threshold: float = catalog.SCORE_THRESHOLD) -> Column:
    """``relevant``, ``not_relevant``, ``unclear`` below the threshold, ``unknown`` on failure."""
    return (
        F.when(best_label.isNull() | score.isNull(), "unknown")
        .when(score < threshold, "unclear")
        .when(best_label.contains(_EVALUATES_PHRASE), "relevant")
        .otherwise("not_relevant")
    )


def relevance_two_way(best_label: Column, score: Column,
                      threshold: float = catalog.SCORE_THRESHOLD) -> Column:
    """``RELEVANT`` or ``NOT_RELEVANT`` on the rounded score; ``ERROR`` on failure."""
    return (
        F.when(best_label.isNull() | score.isNull(), "ERROR")
        .when(rounded(score) < threshold, "NOT_RELEVANT")
        .when(best_label.startswith(_ABOUT_PREFIX), "RELEVANT")
        .otherwise("NOT_RELEVANT")
    )


def sentiment(best_label: Column) -> Column:
    """A sentiment model's label in lower case, ``unknown`` where the model failed."""
    return F.coalesce(F.lower(best_label), F.lit("unknown"))


def sentiment_fields(best_label: Column, score: Column) -> list[Column]:
    """``negative``, ``sentiment_label``, ``sentiment_score``; all null where the model failed."""
    label = F.lower(best_label)
    return [
        (label == "negative").alias("negative"),
        label.alias("sentiment_label"),
        rounded(score).alias("sentiment_score"),
    ]
