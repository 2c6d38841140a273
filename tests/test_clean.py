import pytest
from gabble.catalog import SKATERS, entity_frame
from gabble.operators import clean
from tests.helpers import plan, values

SCHEMA = ("ingest_order bigint, comment string, persoon string, author string, thread_url string, "
          "thread_title string")

ROWS = [
    ("[deleted]", "a", "deleted_text"),
    ("x [deleted] y", "a", ""),
    ("THIS POST WAS MASS DELETED by tool", "a", "deleted_text"),
    ("good text\n*This post was mass deleted*", "a", "deleted_text"),
    ("  deleted ", "a", "deleted_text"),
    (".", "a", "deleted_text"),
    ("", "a", ""),
    ("fine", "[deleted]", "bot_author"),
    ("[removed]", "AutoModerator", "bot_author"),
    ("fine", "AUTOMODERATOR", ""),
    ("\xa0\tpadded text\n", "a", ""),
    ("no author", None, ""),
]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(i, c, "sven", a, "/t/1", "Sven Kramer wins") for i, (c, a, _) in enumerate(ROWS)]
    copies = [(100 + i, *r[1:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows + copies, SCHEMA)


def test_reasons(raw):
    tagged = clean.tag(raw).orderBy("ingest_order").collect()
    assert [r.ingest_order for r in tagged] == list(range(len(ROWS)))
    assert [r.drop_reason for r in tagged] == [reason for _, _, reason in ROWS]
    texts = {r.ingest_order: r.comment for r in tagged}
    assert texts[3] == "good text" and texts[10] == "padded text"


def test_missing_text_is_kept_as_empty(spark):
    df = spark.createDataFrame([(1, None, "sven", "a", "/t/1", None)], SCHEMA)
    row = clean.kept(clean.tag(df), entity_frame(spark, SKATERS)).first()
    assert (row.comment, row.thread_title, row.name_in_comment) == ("", "", False)


def test_first_copy_wins_and_null_keys_are_equal(spark):
    rows = [(3, "x", "sven", None, "/t", ""), (1, "x", "sven", None, "/t", ""),
            (2, "x", "ireen", None, "/t", "")]
    kept = clean.drop_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted(values(kept, "ingest_order")) == [1, 2]
    assert sorted(values(clean.drop_duplicates(kept), "ingest_order")) == [1, 2]


def test_copies_collapse_before_the_shuffle(raw):
    text = plan(clean.drop_duplicates(raw))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_every_row_has_one_status(raw, spark):
    report = {r.status: (r.n_rows, r.share) for r in clean.report(raw).collect()}
    tagged = clean.tag(raw)
    n_kept = clean.kept(tagged, entity_frame(spark, SKATERS)).count()
    dropped = {r.drop_reason: r["count"]
               for r in clean.dropped(tagged).groupBy("drop_reason").count().collect()}
    assert {k: v[0] for k, v in report.items()} == {
        "kept": n_kept, **dropped, "duplicate": len(ROWS)}
    assert sum(n for n, _ in report.values()) == raw.count()
    assert abs(sum(s for _, s in report.values()) - 1) < 1e-5


def test_min_chars_is_an_extra_reason(raw):
    rules = clean.DropRules(min_chars=5)
    reasons = clean.tag(raw, rules).groupBy("drop_reason").count().collect()
    assert {r.drop_reason: r["count"] for r in reasons}["too_short"] == 2


def test_name_flags_use_loose_names(spark):
    rows = [(1, "KRAMER!", "sven", "a", "/1", "speed"), (2, "a cook", "femke", "a", "/2", "Kok wins"),
            (3, "kramer", "nobody", "a", "/3", "kramer")]
    kept = clean.kept(clean.tag(spark.createDataFrame(rows, SCHEMA)), entity_frame(spark, SKATERS))
    flags = {r.ingest_order: (r.name_in_comment, r.name_in_thread) for r in kept.collect()}
    assert flags == {1: (True, False), 2: (False, True), 3: (False, False)}


def test_report_moves_no_text(raw):
    text = plan(clean.report(raw))
    exchange = text.index("Exchange hashpartitioning(digest")
    assert "comment" not in text[exchange:text.index("\n", exchange)]
