"""Contingency tables and the chi-square test of independence."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gabble.operators.report import found_labels, label_matrix

_FRACTION_TERMS = 200
_SERIES_TERMS = 80


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str] | None = None,
             others: str = "fail") -> DataFrame:
    """Counts of ``row`` by ``column``; rows with a null on either side are left out.

    Without ``values`` every value of ``column`` counts; with them another one stops the job, or
    with ``others="drop"`` is left out.
    """
    return label_matrix(df.filter(F.col(row).isNotNull()), row, column, values, others)


def cells(df: DataFrame, row: str, column: str, values: Sequence[str] | None = None,
          others: str = "fail") -> DataFrame:
    """The table in long form with margins and expected counts, empty cells included.

    Everything after the first aggregation works on the few rows of the table. Rows and columns
    without any count are no categories of the test and are left out.
    """
    values = found_labels(df.filter(F.col(row).isNotNull()), column) if values is None else list(values)
    counts = crosstab(df, row, column, values, others)
    # One row of sums, looked up by the others: no window over all rows of the table.
    names = [f"_total_{i}" for i in range(len(values))]
    sums = counts.agg(F.struct(*[F.sum(v).alias(t) for v, t in zip(values, names)], F.lit(0).alias("_none"))).scalar()
    wide = counts.withColumn("_sums", sums).withColumns({t: F.col("_sums")[t] for t in names})
    if not values:
        return wide.selectExpr(f"`{row}` AS row_value", "0L AS row_total", "0L AS n", "0L AS n_columns",
                               "'' AS column_value", "0L AS observed", "0L AS column_total", "0D AS expected")
    present = [F.col(t) > 0 for t in names]
    long = wide.select(
        F.col(row).alias("row_value"),
        reduce(Column.__add__, [F.col(v) for v in values]).alias("row_total"),
        reduce(Column.__add__, [F.col(t) for t in names]).alias("n"),
        reduce(Column.__add__, [p.cast("bigint") for p in present]).alias("n_columns"),
        F.inline(F.array(*[
            F.struct(F.lit(v).alias("column_value"), F.col(v).alias("observed"),
                     F.col(t).alias("column_total"))
            for v, t in zip(values, names)])))
    return (
        long.filter((F.col("row_total") > 0) & (F.col("column_total") > 0))
        .withColumn("expected", F.col("row_total") * F.col("column_total") / F.col("n"))
    )


def chi_square(df: DataFrame, row: str, column: str, values: Sequence[str] | None = None, *,
               correction: bool = True, alpha: float = 0.05, others: str = "fail") -> DataFrame:
    """One row ``statistic, dof, p_value, significant``.

    With one degree of freedom and ``correction`` set, deviations shrink by up to one half (Yates).
    """
    table = cells(df, row, column, values, others)
    gap = F.abs(F.col("observed") - F.col("expected"))
    yates = gap - F.least(F.lit(0.5), gap)
    # The table is a full grid, so the number of its rows follows from that of its cells.
    n_columns = F.max("n_columns")
    n_rows = (F.count("*") / n_columns).cast("bigint")
    sums = table.agg(
        F.sum(gap * gap / F.col("expected")).alias("plain"),
        F.sum(yates * yates / F.col("expected")).alias("corrected"),
        ((n_rows - 1) * (n_columns - 1)).alias("dof"),
    )
    corrected = (F.col("dof") == 1) & F.lit(correction)
    return (
        sums.filter(F.col("plain").isNotNull())
        .select(
            F.when(corrected, F.col("corrected")).otherwise(F.col("plain")).alias("statistic"),
            "dof")
        .withColumn("p_value", chi_square_tail(F.col("statistic"), F.col("dof")))
        .withColumn("significant", F.col("p_value") < alpha)
    )


def chi_square_tail(statistic: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution for whole degrees of freedom.

    Even degrees have a finite sum; odd degrees add a finite sum to the tail of one degree.
    """
    # Terms are carried as logarithms: exp(-x) alone would vanish before large terms make up for it.
    half = statistic / 2
    step = F.ln(half)

    def total(first: Column, count: Column, shift: float) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
            F.struct(first.alias("term"), F.lit(0.0).alias("sum")),
            lambda acc, k: F.struct(
                (acc["term"] + step - F.ln(k + shift)).alias("term"),
                (acc["sum"] + F.exp(acc["term"])).alias("sum")),
            lambda acc: acc["sum"])

    # Terms x^k / k! for k = 0 .. dof/2 - 1.
    even = total(-half, (dof / 2).cast("int"), 0.0)
    # Terms x^(k+1/2) / Gamma(k+3/2) for k = 0 .. (dof-3)/2.
    first = step / 2 - half + F.lit(math.log(2 / math.sqrt(math.pi)))
    odd = _erfc(F.sqrt(half)) + F.when(dof == 1, F.lit(0.0)).otherwise(
        total(first, ((dof - 1) / 2).cast("int"), 0.5))
    return (
        F.when((dof == 0) | (statistic <= 0), F.lit(1.0))
        .when(dof % 2 == 0, F.least(even, F.lit(1.0)))
        .otherwise(F.least(odd, F.lit(1.0)))
    )


def _erfc(z: Column) -> Column:
    """Complementary error function: power series below 2, continued fraction above."""
    root_pi = F.sqrt(F.lit(3.141592653589793))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(_SERIES_TERMS)),
        F.struct(z.alias("term"), z.alias("sum")),
        lambda acc, k: F.struct(
            (acc["term"] * 2 * z * z / (2 * k + 1)).alias("term"),
            (acc["sum"] + acc["term"] * 2 * z * z / (2 * k + 1)).alias("sum")),
        lambda acc: acc["sum"])
    fraction = F.aggregate(
        F.sequence(F.lit(_FRACTION_TERMS), F.lit(1), F.lit(-1)), z,
        lambda acc, k: z + (k / 2) / acc)
    gauss = F.exp(-z * z)
    return F.when(z < 2, 1 - 2 / root_pi * gauss * series).otherwise(gauss / root_pi / fraction)
