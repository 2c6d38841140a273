import math

import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from gabble.catalog import SKATERS, entity_frame
from gabble.operators import report, stats
from tests.helpers import plan

LABELS = ["negative", "neutral", "positive"]


def table(spark, counts):
    """Rows with the given counts per gender and label."""
    rows = [(g, s) for g, found in counts.items() for s, n in found.items() for _ in range(n)]
    return spark.createDataFrame(rows, "gender string, sentiment string")


@pytest.fixture(scope="module")
def scored(spark):
    rows = [("sven", "man", "negative"), ("sven", "man", "neutral"), ("sven", "man", None),
            ("sven", "man", "unknown"), ("jutta", "vrouw", "negative"), ("ireen", "vrouw", None)]
    return spark.createDataFrame(rows, "persoon string, gender string, sentiment string").withColumn(
        "negative", F.col("sentiment") == "negative")


def test_counts(scored):
    assert [tuple(r) for r in report.count_by(scored, "persoon").collect()] == [
        ("sven", 4), ("ireen", 1), ("jutta", 1)]
    assert [tuple(r) for r in report.count_by(scored, "persoon", by_key=True).collect()] == [
        ("ireen", 1), ("jutta", 1), ("sven", 4)]
    assert {tuple(r) for r in report.label_counts(scored, "sentiment").collect()} == {
        ("negative", 2), ("neutral", 1), ("unknown", 1)}
    with_null = report.label_counts(scored, "sentiment", with_null=True).collect()
    assert (None, 2) in {tuple(r) for r in with_null}


def test_matrix_has_zeros(scored):
    for labels in (None, ["negative", "neutral", "unknown"]):
        got = {r.persoon: (r.negative, r.neutral, r.unknown) for r in
               report.label_matrix(scored, "persoon", "sentiment", labels).collect()}
        assert got == {"sven": (1, 1, 1), "jutta": (1, 0, 0)}


def test_denominators_differ(scored):
    rate = {r.persoon: (r.totaal, r.negatief, r.pct_negatief) for r in
            report.negative_rate(scored).collect()}
    assert rate == {"sven": (3, 1, 33.3), "jutta": (1, 1, 100.0), "ireen": (0, 0, None)}
    known = {r.persoon: r.totaal for r in report.negative_rate(scored, exclude_unknown=True).collect()}
    assert known["sven"] == 2
    by_gender = {r.gender: (r.n_negative, r.n_rows) for r in report.rate_by(scored, ["gender"]).collect()}
    assert by_gender == {"man": (1, 4), "vrouw": (1, 2)}
    assert tuple(report.rate_by(scored).first()) == (2, 6, 33.333333)
    assert {tuple(r) for r in report.flagged_by(scored).collect()} == {("man", 1), ("vrouw", 1)}


def test_funnel_and_flags(spark, scored):
    assert tuple(report.funnel(scored, F.col("negative")).first()) == (6, 2, 4)
    flags = spark.createDataFrame([(True, True), (True, None), (False, True)], "a boolean, b boolean")
    assert report.filter_flags(flags, ["a", "b"]).count() == 1


def test_overview_and_tiers(spark):
    threads = spark.createDataFrame(
        [("sven", "a", 1), ("sven", "b", 2), ("sven", "c", 2), ("jutta", "a", 2)],
        "persoon string, thread_id string, tier int")
    comments = spark.createDataFrame(
        [("sven", "a"), ("sven", "a"), ("sven", "b")], "persoon string, thread_id string")
    view = {r.persoon: (r.comments, r.threads_empty) for r in
            report.overview(entity_frame(spark, SKATERS), threads, comments).collect()}
    assert len(view) == 6
    assert (view["sven"], view["jutta"], view["ireen"]) == ((3, 1), (0, 1), (0, 0))
    tiers = {tuple(r) for r in report.tier_report(entity_frame(spark, SKATERS), threads, comments).collect()}
    assert len(tiers) == 6 and tiers >= {("sven", 2, 1, 1), ("jutta", 0, 0, 1), ("ireen", 0, 0, 0)}
    sizes = {tuple(r) for r in report.tier_sizes(entity_frame(spark, SKATERS), threads.union(threads)).collect()}
    assert len(sizes) == 6 and sizes >= {("sven", 1, 2, 3), ("jutta", 0, 1, 1), ("ireen", 0, 0, 0)}


def test_known_tables(spark):
    three = table(spark, {"man": dict(zip(LABELS, (15, 60, 25))), "vrouw": dict(zip(LABELS, (30, 50, 20)))})
    got = stats.chi_square(three, "gender", "sentiment", LABELS).first()
    assert (round(got.statistic, 4), got.dof, round(got.p_value, 6), got.significant) == (
        6.4646, 2, 0.039466, True)
    two = table(spark, {"man": {"a": 30, "b": 70}, "vrouw": {"a": 45, "b": 55}})
    assert stats.chi_square(two, "gender", "sentiment", ["a", "b"], correction=False).first().statistic \
        == pytest.approx(4.8)
    corrected = stats.chi_square(two, "gender", "sentiment", ["a", "b"]).first()
    assert corrected.statistic == pytest.approx(4.1813, abs=1e-4)
    assert corrected.p_value == pytest.approx(math.erfc(math.sqrt(corrected.statistic / 2)))


def test_correction_never_overshoots(spark):
    near = table(spark, {"man": {"a": 10, "b": 10}, "vrouw": {"a": 10, "b": 10}})
    got = stats.chi_square(near, "gender", "sentiment", ["a", "b"]).first()
    assert (got.statistic, got.p_value, got.significant) == (0.0, 1.0, False)


def test_agrees_with_the_ml_test(spark):
    counts = {"a": (3, 9, 0, 4), "b": (5, 1, 7, 2), "c": (8, 8, 1, 1)}
    names = ["w", "x", "y", "z"]
    df = table(spark, {g: dict(zip(names, row)) for g, row in counts.items()})
    for labels in (names, names[:2]):
        part = df.filter(F.col("sentiment").isin(labels))
        index = StringIndexer(inputCols=["gender", "sentiment"], outputCols=["g", "s"])
        indexed = index.fit(part).transform(part)
        vectors = VectorAssembler(inputCols=["s"], outputCol="v").transform(indexed)
        want = ChiSquareTest.test(vectors, "v", "g").first()
        got = stats.chi_square(df, "gender", "sentiment", labels, correction=False, others="drop").first()
        assert got.statistic == pytest.approx(want.statistics[0])
        assert got.dof == want.degreesOfFreedom[0]
        assert got.p_value == pytest.approx(want.pValues[0])


def test_empty_categories_are_no_categories(spark):
    df = table(spark, {"man": {"a": 5, "b": 6}, "vrouw": {"a": 7, "b": 2}})
    got = stats.chi_square(df, "gender", "sentiment", ["a", "b", "never"]).first()
    assert got.dof == 1
    one = stats.chi_square(df, "gender", "sentiment", ["a"], others="drop").first()
    assert (one.dof, one.p_value) == (0, 1.0)
    assert stats.chi_square(df.limit(0), "gender", "sentiment", ["a"]).count() == 0


def test_every_label_counts(spark):
    df = table(spark, {"man": {"a": 5, "b": 6, "unknown": 9}, "vrouw": {"a": 7, "b": 2, "unknown": 1}})
    assert stats.chi_square(df, "gender", "sentiment").first().dof == 2
    assert set(report.label_matrix(df, "gender", "sentiment").columns) == {"gender", "a", "b", "unknown"}
    with pytest.raises(Exception, match="outside the given list: unknown"):
        stats.chi_square(df, "gender", "sentiment", ["a", "b"]).collect()
    assert stats.chi_square(df, "gender", "sentiment", ["a", "b"], others="drop").first().dof == 1
    assert stats.cells(df.limit(0), "gender", "sentiment").count() == 0
    assert "SinglePartition" not in plan(stats.cells(df, "gender", "sentiment", ["a", "b", "unknown"])).split("Subquery")[0]


@pytest.mark.parametrize("x, dof, want", [
    (3000.0, 1000, 0.0), (1500.0, 1500, 0.4951), (1000.0, 1001, 0.503), (1100.0, 1000, 0.0143), (2000.0, 1, 0.0), (0.0, 7, 1.0)])
def test_tails_of_large_numbers(spark, x, dof, want):
    tail = spark.range(1).select(stats.chi_square_tail(F.lit(x), F.lit(dof)).alias("p")).first().p
    assert tail == pytest.approx(want, abs=2e-3)


@pytest.mark.parametrize("dof, critical", [
    (1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729), (5, 11.070498), (6, 12.591587),
    (7, 14.067140), (10, 18.307038), (21, 32.670573), (50, 67.504807)])
def test_five_percent_quantiles(spark, dof, critical):
    tail = spark.range(1).select(stats.chi_square_tail(F.lit(critical), F.lit(dof)).alias("p")).first().p
    assert tail == pytest.approx(0.05, abs=1e-7)


@pytest.mark.parametrize("x", [0.0, 0.01, 1.0, 7.9, 8.1, 30.0, 400.0])
def test_one_degree_is_erfc(spark, x):
    tail = spark.range(1).select(stats.chi_square_tail(F.lit(x), F.lit(1)).alias("p")).first().p
    assert tail == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9)


def test_margins(spark):
    df = table(spark, {"man": dict(zip(LABELS, (1, 0, 3))), "vrouw": dict(zip(LABELS, (2, 5, 1)))})
    cells = stats.cells(df, "gender", "sentiment", LABELS).collect()
    assert len(cells) == 6 and sum(c.observed for c in cells) == cells[0].n == 12
    assert sum(c.expected for c in cells) == pytest.approx(12)
    wide = {r.gender: (r.negative, r.neutral, r.positive) for r in
            stats.crosstab(df, "gender", "sentiment", LABELS).collect()}
    assert wide == {"man": (1, 0, 3), "vrouw": (2, 5, 1)}
