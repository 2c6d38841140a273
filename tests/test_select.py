import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gabble.operators import select
from tests.helpers import plan, values


@pytest.fixture(scope="module")
def skewed(spark):
    """600 rows in many partitions, most of them in one group."""
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 4}", i, rng.randrange(40)) for i in range(600)]
    return rows, spark.createDataFrame(rows, "g string, id bigint, score int").repartition(13)


def best(rows, n):
    groups = {}
    for g, i, s in rows:
        groups.setdefault(g, []).append((-s, i))
    return sorted((g, i) for g, found in groups.items() for _, i in sorted(found)[:n])


@pytest.mark.parametrize("few", [False, True])
@pytest.mark.parametrize("n", [1, 7, 1000])
def test_top_per_group_equals_brute_force(skewed, few, n):
    rows, df = skewed
    top = select.top_per_group(df, ["g"], [F.col("score").desc(), F.col("id")], n, few_groups=few)
    assert sorted((r.g, r.id) for r in top.collect()) == best(rows, n)


def test_groups_shrink_before_every_shuffle(skewed):
    _, df = skewed
    text = plan(select.top_per_group(df, ["g"], [F.col("id")], 5, few_groups=True))
    assert text.count("WindowGroupLimit") == 4


def test_large_limits_shrink_groups_too(skewed):
    _, df = skewed
    assert "WindowGroupLimit" in plan(select.top_per_group(df, ["g"], [F.col("id")], 50_000))


@pytest.mark.parametrize("limit, tiers, expected", [
    (3, [(1, 5), (1, 1), (2, 9), (2, 8)], [(1, 1), (1, 5), (2, 9)]),
    (3, [(1, 5), (1, 1), (1, 2), (1, 3), (2, 9)], [(1, 2), (1, 3), (1, 5)]),
    (3, [(2, 5), (2, 1)], [(2, 1), (2, 5)]),
])
def test_budget_fills_tier_one_first(spark, limit, tiers, expected):
    rows = [("sven", f"t{i}", tier, score) for i, (tier, score) in enumerate(tiers)]
    df = spark.createDataFrame(rows, "persoon string, thread_id string, tier int, score int")
    chosen = select.thread_budget(df, limit).collect()
    assert sorted((r.tier, r.score) for r in chosen) == expected


def test_unify_threads_takes_the_last_search_and_skips_missing_ids(spark):
    rows = [("sven", "a", 0, 1), ("sven", "a", 1, 2), ("ireen", "a", 0, 3), ("sven", "", 0, 4),
            ("sven", None, 0, 5)]
    df = spark.createDataFrame(rows, "persoon string, thread_id string, query_index int, score int")
    assert sorted(values(select.unify_threads(df), "score")) == [2, 3]


def test_dedupe_by_priority(spark):
    rows = [("sven", "c", 2, 99, "x"), ("sven", "c", 1, 1, "y"), ("sven", "c", 1, 5, "z"),
            ("ireen", "c", 2, 7, "x")]
    df = spark.createDataFrame(
        rows, "persoon string, comment_id string, tier int, thread_score int, thread_id string")
    assert sorted(values(select.dedupe_by_priority(df), "thread_id")) == ["x", "z"]


def test_last_per_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 1)], "k string, run int")
    assert sorted(map(tuple, select.last_per_key(df, ["k"], "run").collect())) == [("a", 3), ("b", 1)]


def test_sample_size_and_stability(spark):
    df = spark.range(100).select(
        F.col("id").cast("string").alias("comment_id"),
        F.when(F.col("id") < 4, "small").otherwise("big").alias("persoon"))
    first = select.sample_per_group(df, ["persoon"], 10)
    again = select.sample_per_group(df.repartition(17), ["persoon"], 10)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    sizes = {r.persoon: r["count"] for r in first.groupBy("persoon").count().collect()}
    assert sizes == {"small": 4, "big": 10}
    other = select.sample_per_group(df, ["persoon"], 10, seed=7)
    assert sorted(map(tuple, first.collect())) != sorted(map(tuple, other.collect()))


def test_label_sheet_skips_missing_comments(spark):
    df = spark.createDataFrame(
        [("1", "sven", "man", "s", None), ("2", "sven", "man", "s", "x")],
        "comment_id string, persoon string, gender string, subreddit string, comment string")
    sheet = select.label_sheet(df)
    assert sheet.columns == ["persoon", "gender", "subreddit", "comment", "manual_label",
                             "model_deberta", "model_gpt", "model_claude"]
    assert [tuple(r) for r in sheet.collect()] == [("sven", "man", "s", "x", "", "", "", "")]


@pytest.mark.parametrize("small", [10_000, 1])
@pytest.mark.parametrize("start, stop", [
    (0, 10), (100, 1100), (2990, None), (None, None), (1500, 1501), (3000, 4000), (5, 5), (None, 3)])
def test_slice_equals_brute_force(spark, monkeypatch, start, stop, small):
    monkeypatch.setattr(select, "_SLICE_ROWS", small)
    rng = random.Random(3)
    keys = rng.sample(range(10**18), 1500) + list(range(1500))
    df = spark.createDataFrame([(k,) for k in keys], "ingest_order bigint").repartition(9)
    got = sorted(values(select.slice_rows(df, start, stop), "ingest_order"))
    assert got == sorted(keys)[start:stop]


def test_slice_is_a_plain_range_of_the_rows(spark):
    df = spark.range(100).withColumnRenamed("id", "ingest_order")
    assert "Exchange" not in plan(select.slice_rows(df, 10, 20))


def test_slice_of_doubles(spark):
    df = spark.range(3000).select((F.col("id") / 7).alias("ingest_order")).repartition(5)
    got = sorted(values(select.slice_rows(df, 1000, 1003), "ingest_order"))
    assert got == [1000 / 7, 1001 / 7, 1002 / 7]


def test_slice_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(2,), (1,)], "ingest_order bigint")
    assert values(select.slice_rows(df, 1, 2), "ingest_order") == [2]
    assert select.slice_rows(df.limit(0), 0, 5).count() == 0


def test_period_bound_reaches_the_scan(spark, folder):
    times = [datetime(2024, 1, d) for d in (1, 10, 20)]
    spark.createDataFrame([(t, int(t.timestamp())) for t in times],
                          "ts timestamp_ntz, sec bigint").write.parquet(folder + "/p")
    df = spark.read.parquet(folder + "/p")
    week = select.filter_period(df, "ts", "week", datetime(2024, 1, 20))
    assert values(week, "ts") == times[2:]
    assert "GreaterThanOrEqual(ts" in plan(week)
    month = select.filter_period(df, "sec", "month", int(times[2].timestamp()))
    assert month.count() == 3 and "GreaterThanOrEqual(sec" in plan(month)
    assert select.filter_period(df, "ts", "all", datetime(2024, 1, 20)).count() == 3


def test_saved_sample_is_reused(spark, folder):
    df = spark.range(50).selectExpr("cast(id AS string) AS comment_id", "'sven' AS persoon")
    first = sorted(values(select.saved_sample(df, folder + "/s", ["persoon"], 16), "comment_id"))
    grown = df.unionByName(spark.range(50, 500).selectExpr("cast(id AS string)", "'sven'").toDF(*df.columns))
    again = sorted(values(select.saved_sample(grown, folder + "/s", ["persoon"], 16), "comment_id"))
    assert len(first) == 16 and first == again


def test_winners_do_not_depend_on_the_partitioning(spark):
    rows = [("p", f"t{i % 5}", i % 2, i % 7, f"title {i % 3}") for i in range(50)]
    found = spark.createDataFrame(rows, "persoon string, thread_id string, query_index int, score int, title string")
    listed = found.withColumn("position", F.col("score") * 10)
    for frame in (found, listed):
        for pick in (select.unify_threads, lambda df: select.last_per_key(df, ["thread_id"], "query_index")):
            results = {tuple(sorted(map(tuple, pick(frame.repartition(n)).collect()))) for n in (1, 3, 8)}
            assert len(results) == 1
    winners = {r.thread_id: r.score for r in select.unify_threads(listed).collect()}
    assert winners == {t: max(r[3] for r in rows if r[1] == t and r[2] == 1) for t in winners}
