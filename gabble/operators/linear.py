"""A linear text classifier trained in a fixed number of full-batch steps.

Words are hashed into ``FEATURES`` cells. Each step is one pass over the stored cells of the training
rows: the tasks sum the gradient per cell before the shuffle, so that a step moves at most ``FEATURES``
rows a task, however many texts there are. The weights are one array of ``FEATURES + 1`` numbers, the
only thing that every task gets. Nothing is drawn at random: the same rows give the same model.

A text without words, or a null one, has the constant cell alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gabble.functions import rules
from gabble.operators.score import _distinct_words
from gabble.session import written

#: Cells of the hash; the constant has the number after the last one.
FEATURES = 1 << 16

#: Full-batch steps; the share of a Newton step per cell that each takes; what is added to a cell's curvature;
#: and the weight of the ridge.
STEPS = 8
DAMP = 0.3
DRAG = 5.0
RIDGE = 0.5


def cells(text: str) -> Column:
    """The distinct cells of a text's words, and the constant cell: the first four hex digits of the MD5 digest."""
    hashed = F.transform(_distinct_words(text), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"))
    return F.concat(F.array(F.lit(FEATURES)), F.array_distinct(F.coalesce(hashed, F.array().cast("array<int>"))))


def _with_probability(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Add ``_p``, the probability of class 1; a cell counts 1 / sqrt(number of cells)."""
    total = F.aggregate("_cells", F.lit(0.0), lambda s, c: s + F.get("_w", c))
    return (rows.withColumn("_w", weights.scalar())
            .withColumn("_p", 1 / (1 + F.exp(-total / F.sqrt(F.size("_cells"))))).drop("_w"))


def _array(state: DataFrame) -> DataFrame:
    """One row: the weight of each cell times its idf, in the order of the cells."""
    one = F.struct("cell", (F.col("weight") * F.col("idf")).alias("w"))
    return state.agg(F.array_sort(F.collect_list(one))["w"].alias("weights"))


def train(labelled: DataFrame, text: str = "comment", target: str = "target", steps: int = STEPS) -> DataFrame:
    """One row, ``weights array<double>``: a logistic regression on idf-weighted cells after ``steps`` steps.

    ``target`` above 0 is class 1, a null one is left out. Each step moves every cell by its own slope and
    curvature. Without training rows all weights are 0, and both classes have one half.
    """
    spark = labelled.sparkSession
    rows = written(labelled.select(cells(text).alias("_cells"), (F.col(target) > 0).cast("int").alias("_y"))
                   .where("_y is not null"), "cells")
    n = rows.count()
    seen = rows.select(F.explode("_cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    idf = F.when(F.col("cell") == FEATURES, 1.0).otherwise(F.ln((n + 1) / (F.coalesce("n", F.lit(0)) + 1)))
    # The state has FEATURES + 1 rows whatever the input, so one file holds it, and sums per cell are broadcast.
    every = spark.range(0, FEATURES + 1, 1, 1).select(F.col("id").cast("int").alias("cell"))
    state = written(every.join(F.broadcast(seen), "cell", "left")
                    .select("cell", idf.alias("idf"), F.lit(0.0).alias("weight")), "weights")
    for _ in range(steps):
        share = F.sqrt(F.size("_cells"))
        sums = (_with_probability(rows, _array(state))
                .select(((F.col("_p") - F.col("_y")) / share).alias("off"),
                        (F.col("_p") * (1 - F.col("_p")) / F.size("_cells")).alias("bend"), F.explode("_cells").alias("cell"))
                .groupBy("cell").agg(F.sum("off").alias("off"), F.sum("bend").alias("bend")))
        slope = F.col("idf") * F.col("off") + RIDGE * F.col("weight")
        curve = F.col("idf") * F.col("idf") * F.col("bend") + DRAG
        # A cell that no training row has keeps its 0.
        state = written(state.join(F.broadcast(sums), "cell", "left").select(
            "cell", "idf", F.coalesce(F.col("weight") - DAMP * slope / curve, F.col("weight")).alias("weight")), "weights")
    return _array(state)


def apply(df: DataFrame, model: DataFrame, keys: Sequence[str], text: str = "comment") -> DataFrame:
    """``keys, prediction, model_score``: the likelier class (1 on a tie) and its probability, without a shuffle."""
    scored = _with_probability(df.select(*keys, cells(text).alias("_cells")), model)
    return scored.select(*keys, (F.col("_p") >= 0.5).cast("int").alias("prediction"),
                         rules.rounded(F.greatest(F.col("_p"), 1 - F.col("_p"))).alias("model_score"))
