"""Toxicity by weak supervision.

Voters: lists of insults, patterns of insults at somebody, and lexicons of word stems that the labelled training
rows use far more often in toxic texts; the annotators' labels of the training rows are one more voter. A
generative label model (:mod:`gabble.llm.label_model`) estimates their accuracies and correlations, and its
posterior labels train a linear classifier over hashed words and word beginnings, which scores every whole text.

Labels are learned from training rows only: those whose crc32 of the id as text is no multiple of five, at most
``max_train`` of them, chosen by hash. Label, language, source and id are no inputs of a score.

Edge cases: a null or empty text is scored by the intercept; a null id is no training row and is not held out;
ids labelled more than once train once for each text and label; without a usable training row the score is 0.5,
with one class it is that class; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gabble.llm import hashed_linear, label_model
from gabble.llm.common import text_of
from gabble.session import written

MAX_TRAIN = 30_000
FOLDS = 5
PREFIXES = (4, 5, 6, 7)
#: Stems in the lexicons, and the least toxic texts that a stem needs.
MAX_STEMS = 1_000
LEAST_TOXIC = 4

#: Voters' word lists.
PERSONS = frozenset("idiot idiots moron morons loser losers scum clown clowns trash jerk fool bastard pig creep freak "
                    "dumbass imbecile cretin".split())
QUALITIES = frozenset("worthless pathetic disgusting stupid dumb ugly useless vile filthy hateful despicable "
                      "retarded braindead".split())
ADDRESS = frozenset("you your you're he she they these those".split())

VOTERS = ("persons", "qualities", "several", "strong_stem", "strong_stems", "weak_stems", "addressed", "annotators")
_EDGE = ".,!?|;:%&*$#\"'()[]<>"


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def bare(text: str) -> list[str]:
    """Lower-case words without signs at their ends."""
    return [w for w in (x.strip(_EDGE) for x in text.lower().split()) if w]


def stems(word: str) -> list[str]:
    return [word[:n] for n in PREFIXES if len(word) > n]


def word_features(word: str) -> list[str]:
    return ["w:" + word, *("p:" + s for s in stems(word))]


def text_features(text: str) -> tuple[dict[str, float], list[str]]:
    return dict.fromkeys(bare(text), 1.0), []


EXTRACTOR = hashed_linear.Extractor(word_features, text_features)


def vote(text: str, label: int | None, strong: frozenset[str], weak: frozenset[str]) -> list[int]:
    """One vote of each of :data:`VOTERS`."""
    parts = bare(text)
    distinct = set(parts)
    insults = [w for w in parts if w in PERSONS or w in QUALITIES]
    forms = [(w, *stems(w)) for w in distinct]
    marked = [f for f in forms if not strong.isdisjoint(f)]
    hinted = [f for f in forms if not weak.isdisjoint(f)]
    near = any(a in ADDRESS and (b in PERSONS or b in QUALITIES) for a, b in zip(parts, parts[1:]))
    near = near or any(a in ADDRESS and (b in PERSONS or b in QUALITIES) for a, b in zip(parts, parts[2:]))
    return [int(bool(distinct & PERSONS)), int(bool(distinct & QUALITIES)), int(len(insults) > 1),
            int(len(marked) > 0), int(len(marked) > 1),
            1 if len(hinted) > 2 else 0 if hinted or marked or insults else -1, int(near),
            0 if label is None else 1 if label else -1]


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str,
                  max_train: int) -> DataFrame:
    """``text, label`` of at most ``max_train`` labelled rows outside the held-out fold."""
    picked = (labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label"))
              .where(F.col("_id").isNotNull() & F.col("label").isNotNull()).where(~held_out("_id"))
              .distinct().orderBy(F.xxhash64("_id"), "_id", "label").limit(max_train))
    picked = written(picked, "training")
    # Two numbers for each of at most max_train rows: this side's size is bounded.
    return docs.select(F.col(doc_id).alias("_id"), text_of(text).alias("text")).join(
        F.broadcast(picked), "_id").select("text", "label")


def lexicons(train: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Stems and words that mark toxic texts: strong ones (nearly only there), weak ones (mostly there)."""

    def rows(clean: Counter, toxic: Counter) -> pa.RecordBatch:
        seen = list(clean.keys() | toxic.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.string()), pa.array([clean[s] for s in seen], pa.int64()),
             pa.array([toxic[s] for s in seen], pa.int64())], names=["stem", "clean", "toxic"])

    def run(batches):
        sides = Counter(), Counter()
        for batch in batches:
            for body, label in zip(*(c.to_pylist() for c in batch.columns)):
                sides[label > 0].update({s for w in set(bare(body)) for s in (w, *stems(w))})
                if len(sides[0]) + len(sides[1]) > hashed_linear.REMEMBERED:  # partial sums, to bound the memory
                    yield rows(*sides)
                    sides = Counter(), Counter()
        yield rows(*sides)

    total = train.agg(F.sum((F.col("label") > 0).cast("int")), F.count(F.lit(1))).first()
    if not total[0] or total[0] == total[1]:
        return frozenset(), frozenset()
    base = total[0] / total[1]
    precision = (F.col("toxic") + 2 * base) / (F.col("toxic") + F.col("clean") + 2)
    best = (train.select("text", "label").mapInArrow(run, "stem string, clean long, toxic long")
            .groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
            .where(F.col("toxic") >= LEAST_TOXIC).withColumn("precision", precision)
            .where(F.col("precision") > max(0.3, base))
            .orderBy(F.desc(F.col("toxic") * (F.col("precision") - base)), "stem").limit(MAX_STEMS).collect())
    strong = frozenset(r.stem for r in best if r.precision >= 0.8)
    return strong, frozenset(r.stem for r in best) - strong


def fit(train: DataFrame) -> tuple[np.ndarray, float, label_model.LabelModel]:
    """Weights, intercept and label model from ``text, label``."""
    strong, weak = lexicons(train)

    def run(batches):
        for batch in hashed_linear.small(batches):
            votes, cells, factors = [], [], []
            for body, label in zip(*(c.to_pylist() for c in batch.columns)):
                votes.append(vote(body, label, strong, weak))
                at, factor = EXTRACTOR.vector(body)
                cells.append(at)
                factors.append(factor)
            yield pa.RecordBatch.from_arrays(
                [pa.array(votes, pa.list_(pa.int32())), pa.array(cells, pa.list_(pa.int32())),
                 pa.array(factors, pa.list_(pa.float64()))], names=["votes", "cells", "factors"])

    rows = written(train.select("text", "label").mapInArrow(
        run, "votes array<int>, cells array<int>, factors array<double>"), "votes")
    seen = rows.groupBy("votes").count().collect()  # at most 3 ** voters rows, and max_train
    patterns = np.array([r["votes"] for r in seen], np.int64).reshape(-1, len(VOTERS))
    counts = np.array([r["count"] for r in seen])
    share = Counter()
    for r in seen:
        share[r["votes"][-1]] += r["count"]
    prior = (share[1] + 1) / (share[1] + share[-1] + 2)
    start = np.where(patterns[:, -1] > 0, 0.95, np.where(patterns[:, -1] < 0, 0.05 * prior, prior))
    model = label_model.fit(patterns, counts, prior, start=start)
    posterior = [(r["votes"], float(p)) for r, p in zip(seen, model.posterior(patterns))] if seen else []
    spark = train.sparkSession
    named = spark.createDataFrame(posterior, "votes array<int>, p double")
    weights, intercept = hashed_linear.train(rows.join(F.broadcast(named), "votes"), 2e-4, 0.9)
    return weights, intercept, model


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          max_train: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per document."""
    train = written(training_rows(docs, labels, doc_id, text, label, max_train), "train")
    weights, intercept, _ = fit(train)
    shared = docs.sparkSession.sparkContext.broadcast((weights, intercept))

    def run(batches):
        one = EXTRACTOR.scorer(*shared.value)
        for batch in batches:
            scores = [one(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"),
                       text_of(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")
