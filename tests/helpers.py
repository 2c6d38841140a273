"""Small helpers for reading results and plans in tests."""

import contextlib
import io


def values(df, column):
    return [r[column] for r in df.collect()]


def evaluate(spark, schema, rows, **columns):
    """Evaluate column expressions over hand-made rows, in row order."""
    numbered = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(numbered, f"_i int, {schema}")
    picked = df.select("_i", *[c.alias(n) for n, c in columns.items()]).orderBy("_i").drop("_i")
    return [tuple(r) if len(columns) > 1 else r[0] for r in picked.collect()]


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()
