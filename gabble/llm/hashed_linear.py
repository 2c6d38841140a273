"""A linear scorer over hashed features of words, trained on weighted soft labels.

A text's score is a sum over its words, so a task looks each distinct word up once and remembers its sum of
weights. Weights are one array of ``SIZE`` numbers, whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
SIZE = 1 << BITS
#: Words that a task remembers; bounds its memory.
REMEMBERED = 100_000
#: Documents whose vectors leave a task together.
VECTOR_ROWS = 200

#: Features of a text: (word features by word, with their factor), and features of the whole text.
Features = Callable[[str], tuple[dict[str, float], list[str]]]


def cell(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) & (SIZE - 1)


def small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of :data:`VECTOR_ROWS` documents at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, VECTOR_ROWS):
            yield batch.slice(at, VECTOR_ROWS)


class Extractor:
    """Turns texts into sparse vectors, or scores them with given weights."""

    def __init__(self, word_features: Callable[[str], list[str]], features: Features):
        self.word_features, self.features = word_features, features
        self.cells: dict[str, list[int]] = {}

    def _cells(self, word: str) -> list[int]:
        """The cells of a word's features; words met again are remembered."""
        found = self.cells.get(word)
        if found is None:
            if len(self.cells) > REMEMBERED:
                self.cells.clear()
            found = self.cells[word] = [cell(f) for f in self.word_features(word)]
        return found

    def __reduce__(self):
        return Extractor, (self.word_features, self.features)

    def vector(self, text: str) -> tuple[list[int], list[float]]:
        found: dict[int, float] = {}
        parts, whole = self.features(text)
        for word, factor in parts.items():
            for c in self._cells(word):
                found[c] = found.get(c, 0.0) + factor
        for f in whole:
            found[cell(f)] = found.get(cell(f), 0.0) + 1.0
        at = sorted(found)
        return at, [found[i] for i in at]

    def scorer(self, weights: np.ndarray, intercept: float) -> Callable[[str], float]:
        """P(label 1) of a text."""
        sums: dict[str, float] = {}
        values = weights.tolist()

        def score(text: str) -> float:
            parts, whole = self.features(text)
            total = intercept + sum(values[cell(f)] for f in whole)
            if len(sums) > REMEMBERED:
                sums.clear()
            for word, factor in parts.items():
                one = sums.get(word)
                if one is None:
                    one = sums[word] = sum([values[cell(f)] for f in self.word_features(word)])
                total += factor * one
            return 1 / (1 + np.exp(-max(-30.0, min(30.0, total))))

        return score


def train(rows: DataFrame, regularisation: float, lasso: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept from ``cells array<int>, factors array<double>, p double`` (P(label 1) of the row)."""
    vector = F.udf(lambda i, v: SparseVector(SIZE, i, v), VectorUDT())
    soft = rows.select(vector("cells", "factors").alias("features"), "p").select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("one"))
    soft = soft.select("features", "one.label", "one.weight").where("weight > 0.001")
    low, high = rows.agg(F.max(1 - F.col("p")), F.max("p")).first()
    classes = [c for c, weight in ((0.0, low), (1.0, high)) if weight is not None and weight > 0.001]
    if len(classes) < 2:
        return np.zeros(SIZE), 30.0 if classes == [1.0] else -30.0 if classes else 0.0
    model = LogisticRegression(maxIter=rounds, regParam=regularisation, elasticNetParam=lasso, weightCol="weight",
                               standardization=False).fit(soft)
    return model.coefficients.toArray(), float(model.intercept)
