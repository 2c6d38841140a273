import pytest
from pyspark.sql import functions as F

from gabble.functions import modeltext as M
from gabble.functions import rules
from tests.helpers import evaluate


def answer(spark, text):
    return evaluate(spark, "t string", [(text,)], out=M.relevance_answer(F.col("t")))[0]


@pytest.mark.parametrize("text, label, confidence, reason", [
    ('{"label": "relevant ", "confidence": "HIGH", "reason": "x"}', "RELEVANT", "high", "x"),
    ('```json\n{"label": "NOT_RELEVANT"}\n```', "NOT_RELEVANT", "", ""),
    ('Well: {"label": "RELEVANT", "confidence": null, "reason": null}', "RELEVANT", "none", "None"),
    ('\n {"label": "RELEVANT", "confidence": 1} \n', "RELEVANT", "1", ""),
    ('{"label": "MAYBE"}', "ERROR", "", "parse_fail: Bad label: 'MAYBE'"),
    ('{"confidence": "high"}', "ERROR", "", "parse_fail: Bad label: ''"),
    ('Answer: {"a": {"b": 1}}', "ERROR", "",
     'parse_fail: Could not parse JSON from: Answer: {"a": {"b": 1}}'),
    ("no json", "ERROR", "", "parse_fail: Could not parse JSON from: no json"),
    ("", "ERROR", "", "parse_fail: Could not parse JSON from: "),
    ('[{"label": "RELEVANT"}]', "ERROR", "", None),
    ('"{\\"label\\": \\"RELEVANT\\"}"', "ERROR", "", None),
    ('12 {"label": "RELEVANT"}', "RELEVANT", "", ""),
    ('{"label": "NOT_RELEVANT", "label": "RELEVANT"}', "RELEVANT", "", ""),
])
def test_relevance_answer(spark, text, label, confidence, reason):
    got = answer(spark, text)
    assert (got.label, got.confidence) == (label, confidence)
    if reason is not None:
        assert got.reason == reason
    assert got.raw == ("" if label == "ERROR" else text)


def test_long_parts_are_cut_on_request_only(spark):
    long = '{"label": "RELEVANT", "reason": "%s"}' % ("r" * 400)
    got = answer(spark, long)
    assert len(got.reason) == 400 and got.raw == long
    assert len(answer(spark, "z" * 400).reason) > 400
    cut = spark.createDataFrame([(long,), ("z" * 400,)], "t string").select(
        M.relevance_answer(F.col("t"), reason_chars=200, raw_chars=300).alias("a")).collect()
    assert [len(r.a.reason) for r in cut] == [200, 200] and len(cut[0].a.raw) == 300


@pytest.mark.parametrize("text, expected", [
    ('ok {"speedskating": true, "performance": false, "negative": null} done', (True, False, None)),
    ('{"speedskating": true}', (True, None, None)),
    ('{"speedskating": "yes", "negative": true}', (None, None, True)),
    ("no json", (None, None, None)),
    ("", (None, None, None)),
])
def test_flags(spark, text, expected):
    flags = M.flags_answer(F.col("t"))
    got = evaluate(spark, "t string", [(text,)], a=flags["speedskating"], b=flags["performance"],
                   c=flags["negative"])
    assert got == [expected]


def test_context_and_prompt(spark):
    args = [F.col(c) for c in ("sub", "title", "comment")]
    row = [("olympics", "Race\x07 day", "Insane run")]
    schema = "sub string, title string, comment string"
    assert evaluate(spark, schema, row, out=M.context(*args)) == [
        "[Subreddit: r/olympics | Thread: Race day]\nComment: Insane run"]
    assert evaluate(spark, schema, row, out=M.context(*args, comment_chars=6, thread_chars=4)) == [
        "[Subreddit: r/olympics | Thread: Race]\nComment: Insane"]
    assert evaluate(spark, schema, row, out=M.prompt(F.lit("Femke Kok"), *args, preamble="Go.\n")) == [
        "Go.\nTarget skater: Femke Kok\nThread title: Race\x07 day\nSubreddit: r/olympics\n"
        "Comment: Insane run\n\nJSON:"]


def test_missing_text_is_empty_in_prompts(spark):
    args = [F.col(c) for c in ("sub", "title", "comment")]
    assert evaluate(spark, "sub string, title string, comment string", [("s", None, None)],
                    out=M.context(*args)) == ["[Subreddit: r/s | Thread: ]\nComment: "]


def test_no_off_topic_list_means_first_names(spark):
    labels = M.evaluation_labels(F.lit("sven"), F.lit("Sven Kramer"), F.lit("he/him"), F.col("s"), ())
    assert evaluate(spark, "s string", [("soccer",)], out=labels[0]) == [
        "this comment evaluates or describes sven (he/him)"]


def test_sentiment_of_a_failed_model(spark):
    fields = rules.sentiment_fields(F.col("b"), F.col("s"))
    rows = [("Negative", 0.98765), ("neutral", 0.5), (None, None)]
    assert evaluate(spark, "b string, s double", rows, a=fields[0], b=fields[1], c=fields[2]) == [
        (True, "negative", 0.9877), (False, "neutral", 0.5), (None, None, None)]
    assert evaluate(spark, "b string, s double", rows, out=rules.sentiment(F.col("b"))) == [
        "negative", "neutral", "unknown"]


def test_candidate_labels(spark):
    labels = M.evaluation_labels(F.lit("sven"), F.lit("Sven Kramer"), M.pronoun(F.col("g")), F.col("s"))
    got = evaluate(spark, "g string, s string", [("man", "soccer"), ("vrouw", "olympics"), ("man", None)],
                   about=labels[0], other=labels[1])
    assert got == [
        ("this comment evaluates or describes Sven Kramer, Dutch speed skater (he/him)",
         "this comment is not about Sven Kramer or contains no evaluation of Sven Kramer"),
        ("this comment evaluates or describes sven (she/her)",
         "this comment is not about sven or contains no evaluation"),
        ("this comment evaluates or describes sven (he/him)",
         "this comment is not about sven or contains no evaluation")]


@pytest.mark.parametrize("best, score, four, two", [
    ("this comment evaluates or describes x", 0.5499, "unclear", "NOT_RELEVANT"),
    ("this comment evaluates or describes x", 0.55, "relevant", "NOT_RELEVANT"),
    ("this comment is about x as an athlete or person", 0.55, "not_relevant", "RELEVANT"),
    ("this comment is about x as an athlete or person", 0.54996, "unclear", "RELEVANT"),
    ("this comment is not about x", 0.9, "not_relevant", "NOT_RELEVANT"),
    (None, None, "unknown", "ERROR"),
])
def test_decision_rules(spark, best, score, four, two):
    got = evaluate(spark, "b string, s double", [(best, score)],
                   four=rules.relevance_four_way(F.col("b"), F.col("s")),
                   two=rules.relevance_two_way(F.col("b"), F.col("s")))
    assert got == [(four, two)]
