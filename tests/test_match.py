import pytest
from pyspark.sql import functions as F

from gabble.catalog import SKATERS, entity_frame
from gabble.operators import match
from gabble.plans import flows
from tests.helpers import plan, values


@pytest.fixture(scope="module")
def people(spark):
    return entity_frame(spark, SKATERS)


def test_catalog_is_broadcast_by_its_known_size(spark, people):
    df = spark.range(10).withColumn(
        "persoon", F.when(F.col("id") < 10, "sven").otherwise(F.col("id").cast("string")))
    assert "BroadcastHashJoin" in plan(match.attach_entity(df, people, ["gender"]))


def test_large_catalog_is_not_broadcast(spark, people):
    df = spark.range(10).withColumn(
        "persoon", F.when(F.col("id") < 10, "sven").otherwise(F.col("id").cast("string")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64")
    try:
        joined = match.attach_entity(df, people, ["gender", "full_name"])
        assert "BroadcastHashJoin" not in plan(joined)
        assert values(joined, "gender") == ["man"] * 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_unknown_person(spark, people):
    df = spark.createDataFrame([("sven",), ("nobody",)], "persoon string")
    described = {r.persoon: r.description for r in match.described(df, people).collect()}
    assert described == {"sven": "Sven Kramer (Dutch long-track speed skater)", "nobody": "nobody"}
    with pytest.raises(Exception, match="person not in catalog: nobody"):
        match.attach_entity(df, people, ["gender"], strict=True).collect()


def test_tiers_and_ambiguous_surnames(spark, people):
    rows = [("ireen", "Ireen WÜST wint", "hi"), ("femke", "Olympic thread", "Kok is fast"),
            ("femke", "Olympic thread", "femke kok is fast"), ("sven", "Kramer", "kramer"),
            ("kjeld", "x", "go KJELD")]
    df = spark.createDataFrame(rows, "persoon string, title string, comment string")
    tiered = match.tier(df, people)
    tiers = [(r.persoon, r.comment, r.tier) for r in tiered.collect()]
    assert sorted(tiers) == sorted([
        ("ireen", "hi", 1), ("femke", "Kok is fast", 2), ("femke", "femke kok is fast", 2),
        ("sven", "kramer", 2), ("kjeld", "go KJELD", 2)])
    assert sorted(values(match.filter_tier(tiered, people), "comment")) == [
        "femke kok is fast", "go KJELD", "hi"]


def test_search_equals_brute_force(spark):
    texts = ["Ireen Wüst and sven KRAMER", "nothing", None, "jutta leerdam", "Ireen Wust"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    fold = str.maketrans("üöäéèë", "uoaeee")
    expected = sorted(
        (i, e.persoon, q) for i, t in enumerate(texts) if t for e in SKATERS
        for q, phrase in enumerate(e.search_queries)
        if phrase.lower().translate(fold) in t.lower().translate(fold))
    got = match.search(df, SKATERS, "text", ["id"])
    assert sorted(tuple(r) for r in got.collect()) == expected
    assert "Exchange" not in plan(got) and "Join" not in plan(got)


def test_general_subreddits_need_the_name(spark):
    rows = [("gifs", "sven", "great Sven"), ("gifs", "sven", "great race"), ("gifs", "sven", None),
            ("olympics", "sven", "great race"), (None, "sven", "x")]
    df = spark.createDataFrame(rows, "subreddit string, persoon string, comment string")
    kept = [(r.subreddit, r.comment) for r in match.filter_general(df).collect()]
    assert sorted(kept, key=str) == sorted(
        [("gifs", "great Sven"), ("olympics", "great race"), (None, "x")], key=str)
    assert match.filter_allowlist(df).count() == 4


def test_phrase_search_folds(spark):
    df = spark.createDataFrame([("Ireen Wüst",), ("wust",), (None,)], "comment string")
    assert match.filter_phrase(df, "WÜST").count() == 2


def test_thread_join_is_the_same_with_and_without_a_broadcast(spark):
    comments = spark.range(300).select(
        F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 5)).alias("thread_id"),
        F.col("id").cast("string").alias("comment_id"))
    threads = spark.createDataFrame(
        [("hot", "p1"), ("hot", "p2"), ("t1", "p1"), ("none", "p1")], "thread_id string, persoon string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = flows.join_threads(comments, threads)
        assert "SortMergeJoin" in plan(joined) and "Broadcast" not in plan(joined)
        want = sorted(map(tuple, joined.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, flows.join_threads(comments, threads).collect())) == want and len(want) == 420


def test_collection_flow(spark):
    threads = spark.createDataFrame([
        ("a", "/a", "Sven Kramer wins", "sports", 5), ("b", "/b", "Race day", "sports", 9),
        ("c", "/c", "Unrelated", "sports", 99)],
        "thread_id string, url string, title string, subreddit string, score bigint")
    comments = spark.createDataFrame([
        ("a", "1", "u", "great"), ("a", "2", "u", "[deleted]"), ("b", "3", "u", "go Sven Kramer"),
        ("b", "4", "u", "just fast"), ("c", "5", "u", "hello"), ("a", "1", "u", "great")],
        "thread_id string, comment_id string, author string, comment string")
    found = flows.search_threads(threads, comments, SKATERS)
    assert sorted((r.persoon, r.thread_id) for r in found.collect()) == [("sven", "a"), ("sven", "b")]
    got = flows.collect_comments(found, comments, SKATERS)
    assert sorted((r.persoon, r.comment_id, r.tier, r.gender) for r in got.collect()) == [
        ("sven", "1", 1, "man"), ("sven", "3", 2, "man")]
    only_first = flows.collect_comments(found, comments, SKATERS, limit=1)
    assert values(only_first, "comment_id") == ["1"]


def plain_search(texts, phrases):
    return sorted((i, p, q) for i, t in texts for p, q, x in phrases
                  if t is not None and x is not None and fold_by_hand(x) in fold_by_hand(t))


def fold_by_hand(text):
    return text.lower().translate(str.maketrans("üöäéèë", "uoaeee"))


def test_many_phrases_equal_the_plain_search(spark):
    import random

    draw = random.Random(4)
    words = ["Jan", "de", "Vries", "Müller", "a", "é", "x\ny", "ice", "race", "😀"]
    texts = [(i, " ".join(draw.choices(words, k=draw.choice([0, 1, 6, 60])))) for i in range(120)] + [(200, None), (201, "")]
    texts += [(300 + i, "jan de vries") for i in range(100)]
    phrases = [(f"p{i}", i % 3, " ".join(draw.choices(words, k=draw.choice([1, 2, 3])))) for i in range(150)]
    phrases += [("short", 0, "J"), ("same", 1, "de"), ("none", 0, None), ("absent", 0, "nobody at all")]
    df = spark.createDataFrame(texts, "id long, comment string").repartition(4)
    found = match.search_many(df, spark.createDataFrame(phrases, "persoon string, query_index int, phrase string"), "comment", ["id"])
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert sorted(tuple(r) for r in found.collect()) == plain_search(texts, phrases)


def test_fifty_thousand_names(spark):
    from dataclasses import replace

    from gabble.catalog import SKATERS

    people = [replace(SKATERS[0], persoon=f"person {i}", search_queries=(f"Name{i} Family{i * 7}", f"n{i}f")) for i in range(25_000)]
    texts = [(i, f"so NAME{i * 5} family{i * 35} skated, n{i}f too") for i in range(400)]
    found = match.search(spark.createDataFrame(texts, "id long, comment string"), people, "comment", ["id"])
    want = sorted([(i, f"person {i * 5}", 0) for i in range(400)] + [(i, f"person {i}", 1) for i in range(400)])
    assert sorted(tuple(r) for r in found.collect() if r.query_index == 0 or r.persoon == f"person {r.id}") == want


def test_an_empty_phrase_stops_the_job(spark):
    df = spark.createDataFrame([(1, "x")], "id long, comment string")
    with pytest.raises(Exception, match="empty search phrase"):
        match.search_many(df, spark.createDataFrame([("p", 0, "")], "persoon string, query_index int, phrase string"), "comment", ["id"])
