import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gabble.catalog import SKATERS, entity_frame
from gabble.functions import modeltext as M
from gabble.operators import linear, resume, score
from gabble.sources.landed import read_state
from tests.helpers import values

SCHEMA = ("comment_id string, persoon string, comment string, thread_title string, "
          "subreddit string")


@pytest.fixture(scope="module")
def comments(spark):
    return spark.createDataFrame([
        ("1", "sven", "Sven Kramer is a great skater", "x", "olympics"),
        ("2", "sven", "terrible, the worst race", "Sven Kramer wins", "olympics"),
        ("3", "sven", "kramer", "Sven Kramer wins", "soccer"),
        ("4", "jutta", "bad but good", "x", "olympics"),
        ("5", "jutta", "", "x", "olympics"),
        ("6", "jutta", None, None, None),
    ], SCHEMA)


def test_lexicon_sentiment(comments):
    got = score.lexicon_sentiment(comments).orderBy("comment_id").collect()
    assert [(r.sentiment_label, r.negative, r.sentiment_score) for r in got] == [
        ("positive", False, 1.0), ("negative", True, 1.0), ("neutral", False, 1.0),
        ("neutral", False, 0.6667), ("neutral", False, 1.0), (None, None, None)]


def test_negative_flag(comments):
    got = score.negative_flag(comments).orderBy("comment_id")
    assert values(got, "sentiment") == [
        "neutral", "negative", "neutral", "negative", "neutral", None]


def test_relevance_rules(spark, comments):
    got = score.relevance(comments, entity_frame(spark, SKATERS)).orderBy("comment_id").collect()
    assert [(r.label, r.confidence) for r in got] == [
        ("RELEVANT", "high"), ("RELEVANT", "medium"), ("NOT_RELEVANT", "low"),
        ("NOT_RELEVANT", "low"), ("NOT_RELEVANT", "low"), ("NOT_RELEVANT", "low")]


def test_three_flags(comments):
    got = score.three_flags(comments).orderBy("comment_id").collect()
    assert [(r.speedskating, r.performance, r.negative) for r in got] == [
        (True, False, False), (False, True, True), (False, False, False), (False, False, True),
        (None, None, None), (None, None, None)]


def load_fragile():
    def run(texts, labels):
        if any("worst" in t for t in texts):
            raise RuntimeError("model failed")
        return [(c[0] if t else c[1], len(t) / 100) for t, c in zip(texts, labels)]

    return run


def test_a_failing_row_does_not_stop_the_job(comments):
    rows = comments.withColumn("candidate_labels", M.about_labels(F.col("persoon")))
    scored = score.batch_score(rows, load_fragile, ["comment_id", "persoon"])
    got = {r.comment_id: r for r in scored.collect()}
    assert len(got) == 6
    assert (got["2"].best_label, got["2"].model_score) == (None, None)
    assert got["1"].best_label == "this comment is about sven as an athlete or person"
    assert got["3"].model_score == pytest.approx(0.06)
    assert got["6"].best_label == "this comment is not about jutta"


def test_classifier_learns_a_separable_set(spark):
    rows = [(i, "awful bad race" if i % 2 else "great good race", float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, comment string, target double")
    model = score.train_classifier(df)
    wrong = score.apply_classifier(df, model).filter("prediction <> target").count()
    assert wrong == 0


def test_linear_steps_equal_a_plain_replay(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["awful", "bad", "race", "great", "ice", "Ünï"]) for _ in range(rng.randrange(0, 6))) or None)
             for i in range(60)]
    rows = [(i, t, None if i == 7 else float("awful" in (t or ""))) for i, t in texts]
    df = spark.createDataFrame(rows, "id int, comment string, target double").repartition(3)

    def cells(text):
        words = set(re.findall(r"\w+", (text or "").lower()))
        return {linear.FEATURES} | {int(hashlib.md5(w.encode()).hexdigest()[:4], 16) for w in words}

    train = [(cells(t), y) for _, t, y in rows if y is not None]
    every = set().union(*(c for c, _ in train))
    idf = {c: math.log((len(train) + 1) / (sum(c in own for own, _ in train) + 1)) for c in every} | {linear.FEATURES: 1.0}
    weight = dict.fromkeys(every, 0.0)

    def chance(own):
        return 1 / (1 + math.exp(-sum(weight.get(c, 0) * idf.get(c, 0) for c in own) / math.sqrt(len(own))))

    for _ in range(3):
        p = [chance(own) for own, _ in train]
        slope = {c: sum(idf[c] * (q - y) / math.sqrt(len(own)) for q, (own, y) in zip(p, train) if c in own) for c in every}
        curve = {c: sum(idf[c] ** 2 * q * (1 - q) / len(own) for q, (own, _) in zip(p, train) if c in own) for c in every}
        weight = {c: w - linear.DAMP * (slope[c] + linear.RIDGE * w) / (curve[c] + linear.DRAG) for c, w in weight.items()}
    got = {r.id: (r.prediction, r.model_score) for r in linear.apply(df, linear.train(df, steps=3), ["id"]).collect()}
    for i, text in texts:
        p = chance(cells(text))
        assert got[i][0] == (p >= 0.5) and got[i][1] == pytest.approx(max(p, 1 - p), abs=6e-5)


def test_linear_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, comment string").withColumn("target", F.lit(None).cast("int"))
    got = linear.apply(df, linear.train(df, steps=1), ["id"]).collect()
    assert {(r.id, r.prediction, r.model_score) for r in got} == {(1, 1, 0.5), (2, 1, 0.5)}


# --- Join-back and resume --------------------------------------------------------------------------

def results(spark, rows):
    return spark.createDataFrame(rows, "comment_id string, persoon string, label string, run int")


@pytest.fixture(scope="module")
def shared(spark):
    """One comment that belongs to two persons."""
    return spark.createDataFrame([("1", "sven"), ("1", "jutta"), ("2", "sven")],
                                 "comment_id string, persoon string")


def keys(df):
    return sorted((r.comment_id, r.persoon) for r in df.collect())


def test_resume_uses_both_keys(spark, shared):
    done = results(spark, [("1", "sven", "RELEVANT", 0)])
    assert keys(resume.remaining(shared, done)) == [("1", "jutta"), ("2", "sven")]
    assert keys(resume.scored(shared, done)) == [("1", "sven")]


def test_resume_with_nothing_and_everything_done(spark, shared, folder):
    empty = read_state(spark, folder + "/absent", "comment_id string, persoon string")
    assert keys(resume.remaining(shared, empty)) == keys(shared)
    assert keys(resume.remaining(shared, shared)) == []


def test_read_state_reads_what_is_there(spark, shared, folder):
    shared.write.parquet(folder + "/state")
    state = read_state(spark, folder + "/state", "comment_id string, persoon string")
    assert keys(state) == keys(shared)


def test_latest_result_wins_and_rows_stay(spark, shared):
    scores = results(spark, [("1", "sven", "RELEVANT", 0), ("1", "sven", "NOT_RELEVANT", 1)])
    got = {(r.comment_id, r.persoon): r.label
           for r in resume.attach_latest(shared, scores, "run").collect()}
    assert got == {("1", "sven"): "NOT_RELEVANT", ("1", "jutta"): None, ("2", "sven"): None}


def test_null_labels_are_scored_again(spark, shared):
    saved = results(spark, [("1", "sven", None, 0), ("2", "sven", "RELEVANT", 0)])
    assert keys(resume.unlabelled(shared, saved, "label")) == [("1", "jutta"), ("1", "sven")]


def test_two_runs_equal_one(comments):
    once = score.negative_flag(comments).select("comment_id", "persoon", "sentiment")
    first = score.negative_flag(comments.filter("comment_id < '4'")).select(once.columns)
    rest = score.negative_flag(resume.remaining(comments, first)).select(once.columns)
    both = resume.append_results(first, rest)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, once.collect()))


def test_a_saved_column_goes_back_by_position(spark, folder):
    """Files of unequal size; the order is that of the line numbers, not of the files."""
    from gabble.operators import resume

    for name, (low, high) in {"a": (700, 1000), "b": (0, 5), "c": (5, 700)}.items():
        spark.range(low, high).selectExpr("id AS line", "concat('text ', id) AS comment").write.parquet(f"{folder}/{name}")
    rows = spark.read.parquet(f"{folder}/*")
    saved = spark.range(10, 410).selectExpr("id * 3 AS at", "concat('label ', id - 10) AS label")
    out = resume.attach_by_position(rows, saved, "label", ["line"], ["at"]).collect()
    assert [(r.line, r.comment, r.label, r.to_do) for r in sorted(out, key=lambda r: r.position)] == [
        (i, f"text {i}", f"label {i}" if i < 400 else None, i >= 400) for i in range(1000)]
    assert sorted(r.position for r in out) == list(range(1000))


def test_nothing_saved_yet(spark):
    from gabble.operators import resume

    rows = spark.createDataFrame([(2, "b"), (1, "a")], "line int, comment string")
    none = spark.createDataFrame([], "at int, label string")
    out = resume.attach_by_position(rows, none, "label", ["line"], ["at"])
    assert sorted((r.position, r.comment, r.label, r.to_do) for r in out.collect()) == [(0, "a", None, True), (1, "b", None, True)]
    assert resume.attach_by_position(rows.limit(0), none, "label", ["line"], ["at"]).collect() == []
