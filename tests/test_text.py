import pytest
from pyspark.sql import functions as F

from gabble.functions import text as T
from tests.helpers import evaluate


def run(spark, expression, texts):
    return evaluate(spark, "t string", [(t,) for t in texts], out=expression)


def test_fold_maps_the_six_letters_only(spark):
    assert run(spark, T.fold(F.col("t")), ["WÜST ÖÄ ÉÈË", "Ñandú ó", "PLAIN", None]) == [
        "wust oa eee", "ñandú ó", "plain", None]


@pytest.mark.parametrize("text, variants, folded, lowered", [
    ("WÜST!", ["wust", "wüst"], True, True),
    ("Wust", ["wüst"], True, False),
    ("kramers", ["kramer"], True, True),
    ("no name", ["kramer"], False, False),
    (None, ["kramer"], False, False),
    ("kramer", None, False, False),
])
def test_contains_any(spark, text, variants, folded, lowered):
    got = evaluate(
        spark, "t string, v array<string>", [(text, variants)],
        folded=T.contains_any(T.fold(F.col("t")), F.transform("v", T.fold)),
        lowered=T.contains_any(F.lower("t"), F.transform("v", F.lower)))
    assert got == [(folded, lowered)]


DELETED = {
    "[deleted]": True, "[DELETED]": True, "[removed]": True, "[removed]\n": True,
    "x [deleted] y": False, "THIS POST WAS MASS DELETED by tool": True,
    "good text\n*This post was mass deleted*": True, "see: this comment was removed by a mod": True,
    "  deleted ": True, "\tDeleted\n": True, "deleted it": False, ".": True, ".  ": True, "..": False,
    "": False, None: False,
}


def test_deleted_text(spark):
    assert dict(zip(DELETED, run(spark, T.is_deleted_text(F.col("t")), DELETED))) == DELETED


def test_strip_is_pythons_strip(spark):
    texts = ["\xa0\t\n x y \r\n\x1c", " a　", "plain", "", " \n ", "​zero width​"]
    assert run(spark, T.strip(F.col("t")), texts) == [t.strip() for t in texts]


def test_strip_footer(spark):
    texts = [
        "good text\n\n*This post was mass deleted and anonymized with a tool*",
        "good text This post was mass deleted",
        "kept\nThis post was mass deleted on one line\nand text goes on",
        "*this post was mass deleted*",
        "  nothing to cut ",
        None,
    ]
    assert run(spark, T.strip_footer(F.col("t")), texts) == [
        "good text", "good text", texts[2], texts[3], "nothing to cut", None]


def test_strip_control_keeps_tab_and_line_ends(spark):
    assert run(spark, T.strip_control(F.col("t")), ["a\x00b\x07c\td\ne\rf\x1f", None]) == [
        "abc\td\ne\rf", None]


def test_dates_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        got = evaluate(spark, "s bigint", [(0,), (None,), (86399,), (86400,), (-1,), (1709164800,)],
                       out=T.utc_date(F.col("s")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["1970-01-01", "1970-01-01", "1970-01-01", "1970-01-02", "1969-12-31",
                   "2024-02-29"]


def test_epoch_seconds_of_unreadable_values(spark):
    assert run(spark, T.epoch_seconds(F.col("t")), ["12", "x", None, ""]) == [12, 0, 0, 0]


def test_words_need_boundaries(spark):
    texts = ["An IDIOT.", "idiotic", "éidiot", "idiot idiot_x idiot", "", None, "clown-idiot"]
    words = ["idiot", "clown"]
    assert run(spark, T.has_word(F.col("t"), words), texts) == [
        True, False, False, True, False, None, True]
    assert run(spark, T.count_words(F.col("t"), words), texts) == [1, 0, 0, 2, 0, None, 2]


def test_words_of_any_shape(spark):
    texts = ["a b", "c++ rocks", "ab", "x-y]z", "naïef", "NAÏEF!", "(a)"]
    assert run(spark, T.has_word(F.col("t"), ["a", "c++", "y]z", "naïef"]), texts) == [
        True, True, False, True, True, True, True]


def test_live_body_and_membership(spark):
    texts = ["text", "", "[deleted]", "[removed]", "[Deleted]", None]
    assert run(spark, T.is_live_body(F.col("t")), texts) == [True, False, False, False, True, False]
    assert run(spark, T.member(F.col("t"), ["text"]), ["text", "TEXT", None]) == [True, False, False]


def test_url_truncate_defaults(spark):
    assert run(spark, T.absolute_url(F.col("t")), ["/r/x", None]) == [
        "https://www.reddit.com/r/x", "https://www.reddit.com"]
    assert run(spark, T.truncate(F.col("t"), 3), ["abcd", "ü€𝄞x", None]) == ["abc", "ü€𝄞", None]
    assert run(spark, T.truncate(F.col("t"), None), ["abcd"]) == ["abcd"]
    assert run(spark, T.default(F.col("t"), "-"), ["a", None]) == ["a", "-"]
