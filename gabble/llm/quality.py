"""Quality classifier from weak labels.

Heuristic labellers look at signs, case, repetition, vocabulary, line ends and length of a text and vote good, bad
or nothing. Expectation-maximisation over the votes of all documents estimates the labellers' accuracies without
any label. The posterior labels of a bounded sample, at most ``max_train`` documents chosen by hash, train a linear
scorer over hashed words, word shapes and text properties, which scores every whole text.

Edge cases: a null or empty text has no words, gets bad votes and is scored by the text properties; equal texts get
equal scores; a null id is kept; an empty table gives an empty result; other columns pass through ``keep`` and are
not read otherwise.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import repeat
from math import floor
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gabble.llm import hashed_linear, label_model
from gabble.llm.common import text_of
from gabble.session import written

MAX_TRAIN = 20_000
THRESHOLD = 0.5

#: Function words of the languages that the labellers know.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it for on with as was at by this be are or an a "
    "der die das und in den von zu mit sich ist im nicht ein eine auf für dem des "
    "le la les de des et un une en du que qui dans pour par sur est pas au avec "
    "el los las y que se del un una por con para es al no su lo como más".split())
SIGNS = "#*$%&|<>"
LABELLERS = ("signs", "case", "repetition", "vocabulary", "clutter", "length", "line_ends", "word_length", "function_words")
_LETTER, _DIGIT, _AGAIN = re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"(.)\1+")
_MARKS = ".,;:!?"


def _band(value: float, bad: float, good: float) -> int:
    """1 on the good side, -1 on the bad side, 0 between."""
    if bad > good:
        return -1 if value > bad else 1 if value <= good else 0
    return -1 if value < bad else 1 if value >= good else 0


def properties(text: str) -> tuple[list[str], tuple[float, ...]]:
    """Words, and the quantity that each labeller looks at."""
    words = text.split()
    n = max(len(words), 1)
    letters = sum(map(len, words)) or 1
    upper = sum([len(w) > 1 for w in words if w.isupper()])
    same = sum(map(eq, words, words[1:]))
    lines = [line.rstrip() for line in text.split("\n") if line.strip()]
    return words, (
        sum(map(text.count, SIGNS)) / n, upper / n, same / n, len(set(words)) / n ** 0.8,
        sum([len(w) > 2 and not w[-2].isalnum() for w in words if not w[-1].isalnum()]) / n, float(len(words)),
        sum(line.endswith((".", "!", "?", '"', ":", "…")) for line in lines) / max(len(lines), 1), letters / n,
        sum(map(FUNCTION_WORDS.__contains__, map(str.strip, text.lower().split(), repeat(_MARKS)))) / n)


#: For each labeller the bad and the good bound.
BOUNDS = ((0.10, 0.02), (0.50, 0.15), (0.10, 0.02), (0.45, 0.9), (0.20, 0.05), (8.0, 30.0), (0.25, 0.60), (2.2, 3.0), (0.02, 0.08))


def vote(text: str) -> list[int]:
    words, values = properties(text)
    votes = [_band(v, *b) for v, b in zip(values, BOUNDS)]
    return votes if words else [-1] * len(votes)


class _Kinds(dict):
    """What stands for a character in a shape; each is looked at once."""

    def __missing__(self, code: int) -> str:
        one = chr(code)
        kind = ("A" if one.isupper() else "a") if _LETTER.match(one) else "9" if _DIGIT.match(one) else one
        if len(self) < 10_000:
            self[code] = kind
        return kind


_KINDS = _Kinds()
_ASCII = bytes(ord(_KINDS[k]) for k in range(128)) + bytes(128)


@lru_cache(10_000)
def _shape(kinds: str) -> str:
    return "s:" + _AGAIN.sub(r"\1+", kinds)


def word_features(word: str) -> list[str]:
    kinds = word.encode().translate(_ASCII).decode() if word.isascii() else word.translate(_KINDS)
    return ["w:" + word.lower(), _shape(kinds)]


def text_features(text: str) -> tuple[dict[str, float], list[str]]:
    words, values = properties(text)
    n = max(len(words), 1)
    factor = 4 / n
    whole = [f"{name}:{_step(value, bounds)}" for name, value, bounds in zip(LABELLERS, values, BOUNDS)]
    return {w: factor * c for w, c in Counter(words).items()}, whole


def _step(value: float, bounds: tuple[float, float]) -> int:
    """The place of a quantity between its bounds, in steps of a quarter."""
    low, high = min(bounds), max(bounds)
    return max(-4, min(8, floor(4 * (value - low) / (high - low))))


EXTRACTOR = hashed_linear.Extractor(word_features, text_features)


def voted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``votes`` of every document."""

    def run(batches):
        for batch in batches:
            votes = [vote(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.list_(pa.int32()))], names=["votes"])

    return docs.select(text_of(text).alias("text")).mapInArrow(run, "votes array<int>")


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
        max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float, label_model.LabelModel]:
    """Weights, intercept and label model."""
    seen = voted(docs, text).groupBy("votes").count().collect()  # at most 3 ** labellers rows
    patterns = np.array([r["votes"] for r in seen], np.int64).reshape(-1, len(LABELLERS))
    # First guess: one bad vote makes a text doubtful.
    start = np.where((patterns < 0).any(1), 0.1, 0.95)
    model = label_model.fit(patterns, np.array([r["count"] for r in seen]), prior=0.8, correlated=False, start=start)
    order = [F.xxhash64(F.col(doc_id), text_of(text)).alias("h")]
    chosen = written(docs.select(*order).orderBy("h").limit(max_train), "chosen")
    # One number for each of at most max_train rows.
    sample = docs.select(text_of(text).alias("text"), *order).join(F.broadcast(chosen.distinct()), "h").select("text")

    def run(batches):
        for batch in hashed_linear.small(batches):
            texts = batch.column(0).to_pylist()
            vectors = [EXTRACTOR.vector(t) for t in texts]
            p = model.posterior(np.array([vote(t) for t in texts])) if texts else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[0] for v in vectors], pa.list_(pa.int32())),
                 pa.array([v[1] for v in vectors], pa.list_(pa.float64())), pa.array(p, pa.float64())],
                names=["cells", "factors", "p"])

    rows = written(sample.mapInArrow(run, "cells array<int>, factors array<double>, p double"), "vectors")
    return *hashed_linear.train(rows, 1e-5, 0.0, 80), model


def _scores(docs: DataFrame, doc_id: str, text: str, max_train: int):
    weights, intercept, _ = fit(docs, doc_id, text, max_train)
    return docs.sparkSession.sparkContext.broadcast((weights, intercept))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, score, kept``: one row per document; the score is the probability of good quality."""
    shared = _scores(docs, doc_id, text, max_train)

    def run(batches):
        one = EXTRACTOR.scorer(*shared.value)
        for batch in batches:
            scores = np.array([one(t) for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(scores >= THRESHOLD)],
                                             names=["doc_id", "score", "kept"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, kept boolean")


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents of good quality, with all their columns."""
    shared = _scores(docs, doc_id, text, max_train)

    def run(batches):
        one = EXTRACTOR.scorer(*shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield batch.filter(pa.array([one(t or "") >= THRESHOLD for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
