import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gabble.catalog import SKATERS, entity_frame
from gabble.functions import modeltext as M
from gabble.functions import rules
from gabble.operators import clean, report, resume, score
from gabble.plans import flows
from gabble.session import scratch_dir
from gabble.sources import cursors, landed, schemas, sinks, trees
from gabble.streaming import incremental
from tests.helpers import plan, values


def comment(**given):
    row = {f: "" for f in schemas.COMMENT_FIELDS}
    row.update(timestamp=0, score=0, upvotes=0, downvotes=0, golds=0, persoon="sven", gender="man")
    return tuple({**row, **given}.values())


def test_csv_keeps_text(spark, folder):
    texts = ['line\nbreak, "quoted"', "  spaces kept  ", "back\\slash \\\" mix", "cr\r\nlf", "", "tab\t"]
    df = spark.createDataFrame(
        [comment(comment=t, comment_id=str(i)) for i, t in enumerate(texts)], schemas.COMMENTS)
    sinks.write_comments(df, folder + "/csv", "csv")
    back = landed.read_comments(spark, folder + "/csv", "csv")
    assert back.columns == list(schemas.COMMENT_FIELDS)
    assert values(back.orderBy("comment_id"), "comment") == texts


def test_order_follows_the_file(spark, folder):
    df = spark.createDataFrame([comment(comment=f"c{i % 3}", comment_id=f"{i:03}") for i in range(60)],
                               schemas.COMMENTS)
    sinks.write_comments(df.coalesce(1), folder + "/csv", "csv")
    numbered = landed.with_order(landed.read_comments(spark, folder + "/csv", "csv"))
    assert values(clean.drop_duplicates(numbered).orderBy("comment_id"), "comment_id") == [
        "000", "001", "002"]
    ordered = numbered.orderBy("ingest_order")
    assert values(ordered, "comment_id") == [f"{i:03}" for i in range(60)]
    assert numbered.select("ingest_order").distinct().count() == 60


def test_parquet_order_is_that_of_the_files(spark, folder):
    for part in range(3):
        spark.range(part * 1000, part * 1000 + 1000, 1, 1).write.mode("append").parquet(f"{folder}/{part}")
    paths = [f"{folder}/{part}" for part in range(3)]
    results = []
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        results.append({(r.id, r.ingest_order) for r in landed.with_order(spark.read.parquet(*paths)).collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert results[0] == results[1] and len({o for _, o in results[0]}) == 3000
    first = sorted((o, i) for i, o in results[0])[:1000]
    assert [i for _, i in first] == list(range(first[0][1], first[0][1] + 1000))


def test_csv_goes_by_the_header(spark, folder):
    for name, lines in (("a", ["author,comment,extra", 'ann,"hi, ""there""\nx",1']), ("b", ["comment,author", "yes,bob"])):
        with open(f"{folder}/{name}.csv", "w", encoding="utf-8") as out:
            out.write("\n".join(lines) + "\n")
    got = landed.read_csv(spark, folder, "author string, comment string")
    assert sorted(map(tuple, got.collect())) == [("ann", 'hi, "there"\nx'), ("bob", "yes")]
    with pytest.raises(ValueError, match="lacks the columns score"):
        landed.read_csv(spark, folder, "author string, score bigint")
    with open(f"{folder}/b.csv", "w", encoding="utf-8") as out:
        out.write("author,n\nann,many\n")
    with pytest.raises(Exception, match="many"):
        landed.read_csv(spark, f"{folder}/b.csv", "author string, n bigint").collect()


def test_flat_comments_with_float_times(spark, folder):
    path = write_lines(folder, "flat", [{"data": [
        {"body": "x", "created_utc": 1700000000.0, "id": "1"}, {"body": "y", "created_utc": 1700000001, "id": "2"}]}])
    got = landed.read_comments_flat(spark, path)
    assert sorted(values(got, "timestamp")) == [1700000000, 1700000001]
    assert dict(got.dtypes)["timestamp"] == "bigint"


def test_parquet_keeps_missing_apart_from_empty(spark, folder):
    df = spark.createDataFrame([comment(comment=None), comment(comment="")], schemas.COMMENTS)
    sinks.write_comments(df, folder + "/pq")
    assert sorted(values(landed.read_comments(spark, folder + "/pq"), "comment"), key=str) == ["", None]


def write_lines(folder, name, documents):
    path = f"{folder}/{name}.json"
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(json.dumps(d) + "\n" for d in documents)
    return path


def test_thread_listing_defaults(spark, folder):
    path = write_lines(folder, "listing", [
        {"persoon": "sven", "query_index": 0, "data": {"after": "x", "children": [
            {"data": {"permalink": "/r/a/1", "title": "T", "subreddit": "a", "id": "1", "score": 3}},
            {"data": {"permalink": "/r/a/2"}}]}},
        {"persoon": "sven", "query_index": 1, "data": {"children": []}},
        {"persoon": "sven", "query_index": 2}])
    got = sorted(tuple(r) for r in landed.read_thread_listing(spark, path).collect())
    assert got == [
        ("sven", 0, "https://www.reddit.com/r/a/1", "T", "a", "1", 3),
        ("sven", 0, "https://www.reddit.com/r/a/2", "", "", "", 0)]


def page(cursor, after, *names, persoon="sven"):
    return {"persoon": persoon, "query_index": 0, "cursor": cursor, "data": {
        "after": after, "children": [{"data": {"id": n}} for n in names]}}


def ranks(spark, path, **more):
    return {(r.persoon, r.thread_id): (r.page, r.listing_rank) for r in cursors.read_listing(spark, path, **more).collect()}


def test_pages_come_in_the_order_of_their_cursors(spark, folder):
    chain = [page(f"c{i}" if i else None, f"c{i + 1}" if i < 36 else None, f"{i}a", f"{i}b") for i in range(37)]
    chain[5]["data"]["children"] = []
    path = write_lines(folder, "pages", [*reversed(chain), page("", "", "only", persoon="x"), chain[3]])
    want = {("sven", f"{i}{x}"): (i, 2 * i + k - 2 * (i > 5)) for i in range(37) if i != 5 for k, x in enumerate("ab")}
    assert ranks(spark, path) == want | {("x", "only"): (0, 0)}
    assert sorted(ranks(spark, path, limit=3)) == [("sven", "0a"), ("sven", "0b"), ("sven", "1a"), ("x", "only")]
    audit = cursors.audit(landed.read_listing_pages(spark, path)).collect()
    assert [tuple(r) for r in audit] == [("sven", 0, "c3", "repeated", 2)]


def test_gaps_and_loops_of_pages_are_reported(spark, folder):
    gap = [page(None, "c1", "a"), page("c2", "c3", "c"), page("c3", None, "d"), page("c3", None, "d", "e")]
    loop = [page(None, "l1", "p", persoon="loop"), page("l1", "l2", "q", persoon="loop"), page("l2", "l1", "r", persoon="loop")]
    headless = [page("h1", None, "h", persoon=None)]
    path = write_lines(folder, "pages", [*gap, *loop, *headless])
    assert ranks(spark, path) == {
        ("sven", "a"): (0, 0), ("sven", "c"): (None, None), ("sven", "d"): (None, None), ("sven", "e"): (None, None),
        ("loop", "p"): (0, 0), ("loop", "q"): (1, 1), ("loop", "r"): (2, 2), (None, "h"): (None, None)}
    audit = {tuple(r) for r in cursors.audit(landed.read_listing_pages(spark, path)).collect()}
    assert audit == {("sven", 0, "c1", "missing", 0), ("sven", 0, "c2", "unreachable", 1), ("sven", 0, "c3", "unreachable", 2),
                     ("sven", 0, "c3", "repeated", 2), (None, 0, None, "missing", 0), (None, 0, "h1", "unreachable", 1)}
    none = landed.read_listing_pages(spark, write_lines(folder, "none", []))
    assert cursors.in_order(none).count() == 0 and cursors.audit(none).count() == 0


def test_pretty_printed_pages(spark, folder):
    with open(f"{folder}/page.json", "w", encoding="utf-8") as out:
        json.dump({"data": [{"permalink": "/r/a/1", "id": "1"}]}, out, indent=2)
    row = landed.read_thread_listing_flat(spark, f"{folder}/page.json", multi_line=True).first()
    assert (row.thread_id, row.author, row.title) == ("1", "[deleted]", "")


def test_flat_comments(spark, folder):
    path = write_lines(folder, "flat", [{"data": [
        {"body": "hi", "id": "1", "link_id": "t3_abc"}, {"body": "[removed]", "id": "2"},
        {"body": "", "id": "3"}, {"id": "4"}, {"body": "yo", "author": "u", "score": 2,
                                              "created_utc": 9, "id": "5"}]}, {"error": 1}])
    got = sorted(tuple(r) for r in landed.read_comments_flat(spark, path).collect())
    assert got == [("[deleted]", "hi", 0, 0, "1", "abc"), ("u", "yo", 2, 9, "5", None)]


def node(name, body, replies="", **more):
    return {"kind": "t1", "data": {"id": name, "body": body, "replies": replies, **more}}


def listing(*children):
    return {"kind": "Listing", "data": {"children": list(children)}}


def document(thread, *children):
    return [listing({"kind": "t3", "data": {"id": thread}}), listing(*children)]


def walk(children, depth=1):
    """The expected flattening, done by hand."""
    for c in children:
        if c.get("kind") != "t1":
            continue
        if c["data"].get("body") not in ("", None, "[deleted]", "[removed]"):
            yield c["data"]["id"], depth
        if isinstance(c["data"].get("replies"), dict):
            yield from walk(c["data"]["replies"]["data"]["children"], depth + 1)


def test_trees(spark, folder):
    deep = node("d40", "bottom")
    for level in range(39, 0, -1):
        body = "[deleted]" if level % 2 else "text"
        deep = node(f"d{level}", body, listing(deep, node(f"s{level}", "side")))
    wide = [node(f"w{i}", 'says "replies": {') for i in range(50)]
    more = {"kind": "more", "data": {"id": "m", "children": ["x"],
                                     "replies": listing(node("hidden", "no"))}}
    documents = [document("t1", deep, more, *wide), document("t2"), document("t3", node("only", ""))]
    path = write_lines(folder, "trees", [*documents, {"error": 404}, [listing()]])
    got = landed.read_comment_trees(spark, path)
    assert sorted((r.comment_id, r.depth) for r in got.collect()) == sorted(
        found for d in documents for found in walk(d[1]["data"]["children"]))
    assert values(got.select("thread_id").distinct(), "thread_id") == ["t1"]
    assert "Exchange" not in plan(got)


def test_tree_fields_and_defaults(spark, folder):
    full = node("a", "x", author="u", permalink="/c/a", created_utc=1700000000.0, score=5, ups=6,
                downs=1, gilded=2)
    path = write_lines(folder, "one", [document("t1", full, node("b", "y", None))])
    rows = {r.comment_id: r for r in landed.read_comment_trees(spark, path).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.url, a.author, a.date, a.timestamp, a.score, a.upvotes, a.downvotes, a.golds) == (
        "https://www.reddit.com/c/a", "u", "2023-11-14", 1700000000, 5, 6, 1, 2)
    assert (b.url, b.author, b.date, b.timestamp, b.score) == (
        "https://www.reddit.com", "", "1970-01-01", 0, 0)


def chain(length):
    """A document with one chain of replies, written without recursion."""
    head = '{"kind":"Listing","data":{"children":[{"kind":"t1","data":{"id":"%d","body":"b","replies":'
    return ('[{"data":{"children":[{"data":{"id":"t"}}]}},' + "".join(head % i for i in range(length))
            + '""' + "}}]}}" * length + "]")


def test_deep_wide_and_large_trees_come_out_whole(spark):
    wide = document("w", *[node(f"w{i}", "x" * 50, listing(node(f"r{i}", "y"))) for i in range(20_000)])
    texts = [chain(1), chain(100), json.dumps(wide)]
    rows = landed.flatten_trees(spark.createDataFrame([(t,) for t in texts], "page string").repartition(3), "page").collect()
    assert Counter(r.thread_id for r in rows) == {"t": 101, "w": 40_000}
    assert max(r.depth for r in rows) == 100


def test_the_frontier_spreads_over_tasks(spark, monkeypatch):
    """What lies below the first round stands on lines of its own."""
    seen = []
    read = trees._read
    monkeypatch.setattr(trees, "LEVELS", 1)
    monkeypatch.setattr(trees, "_read", lambda lines, kind: seen.append(lines.count()) or read(lines, kind))
    wide = document("w", *[node(f"w{i}", "x", listing(node(f"r{i}", "y"))) for i in range(300)])
    assert len(landed.flatten_trees(spark.createDataFrame([(json.dumps(wide),)], "page string"), "page").collect()) == 600
    assert seen == [1, 300]


def test_items_of_another_shape_cost_only_themselves(spark):
    inner = listing(3, node("c", "z", 7), {"kind": "t1", "data": 5}, node("d", "w", listing(node("e", "v"))))
    texts = [document("o", "junk", 7, None, node("a", "x", [1]), node("b", "y", inner)), {"error": 404}, [], 7, None]
    rows = landed.flatten_trees(spark.createDataFrame([(json.dumps(t),) for t in texts], "page string"), "page").collect()
    assert sorted((r.thread_id, r.comment_id, r.depth) for r in rows) == [
        ("o", "a", 1), ("o", "b", 1), ("o", "c", 2), ("o", "d", 2), ("o", "e", 3)]


def test_unreadable_trees_are_never_lost(spark):
    bad = ['[{"data": ', "[1,]", "{} {}", '{"a" 1}', '["\\x"]', "", "[1 2]", "nul"]
    raw = spark.createDataFrame([(t,) for t in [chain(2), *bad, None]], "page string")
    with pytest.raises(Exception, match="UnreadableDocument"):
        landed.flatten_trees(raw, "page").collect()
    assert landed.flatten_trees(raw, "page", unreadable="skip").count() == 2
    assert sorted(values(trees.unreadable_documents(raw, "page"), "document")) == sorted(bad)


def test_one_document_per_file(spark, folder):
    with open(f"{folder}/thread.json", "w", encoding="utf-8") as out:
        json.dump(document("t1", node("a", "x", listing(node("b", "y")))), out, indent=1)
    got = landed.read_comment_trees(spark, folder, whole_files=True)
    assert sorted(values(got, "comment_id")) == ["a", "b"]


def test_split_sink(spark, folder):
    tagged = spark.createDataFrame([("1", ""), ("2", "bot_author"), ("3", "")],
                                   "comment_id string, drop_reason string")
    sinks.write_split(tagged, folder + "/split")
    kept, audit = sinks.read_kept(spark, folder + "/split"), sinks.read_dropped(spark, folder + "/split")
    assert kept.columns == ["comment_id"] and sorted(values(kept, "comment_id")) == ["1", "3"]
    assert [tuple(r) for r in audit.collect()] == [("2", "bot_author")]
    assert "PartitionFilters: [isnotnull(side" in plan(kept)


def test_person_folders_prune(spark, folder):
    df = spark.createDataFrame([("1", "sven"), ("2", "jutta")], "comment_id string, persoon string")
    sinks.write_per_person(df, folder + "/people")
    one = sinks.read_per_person(spark, folder + "/people", df.schema.toDDL(), ["sven"])
    assert values(one, "comment_id") == ["1"] and "PartitionFilters: [isnotnull(_person" in plan(one)


def test_person_folders_keep_every_name(spark, folder):
    rows = [("1", "007"), ("2", ""), ("3", None), ("4", "2020-01-01"), ("5", "a/b=c")]
    df = spark.createDataFrame(rows, "comment_id string, persoon string")
    sinks.write_per_person(df, folder + "/people")
    ddl = "comment_id string, persoon string"
    back = sinks.read_per_person(spark, folder + "/people", ddl)
    assert sorted(map(tuple, back.collect())) == rows
    some = sinks.read_per_person(spark, folder + "/people", ddl, ["", "007"])
    assert sorted(map(tuple, some.collect())) == rows[:2]


def test_export_is_printable(spark, folder):
    df = spark.createDataFrame([("a\x01b", 1)], "t string, n int")
    sinks.export_sample(df, folder + "/sheet")
    assert values(landed.read_csv(spark, folder + "/sheet", "t string, n int"), "t") == ["ab"]


def test_relevant_sink(spark, folder):
    rows = [("1", "relevant"), ("2", "unclear"), ("3", None)]
    df = spark.createDataFrame(rows, "id string, relevance string")
    sinks.write_relevant(df, folder + "/relevant", "relevance")
    assert values(spark.read.parquet(folder + "/relevant"), "id") == ["1"]


def test_bucketed_tables_join_without_a_shuffle(spark, folder):
    comments = spark.range(200).selectExpr("cast(id AS string) AS comment_id", "'p' || id % 3 AS persoon")
    scores = comments.filter("cast(comment_id AS int) < 50").withColumn("label", F.lit("x"))
    sinks.write_bucketed(comments, "b_comments", folder + "/c", resume.SCORE_KEY, 4)
    sinks.write_bucketed(scores, "b_scores", folder + "/s", resume.SCORE_KEY, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = resume.remaining(spark.table("b_comments"), spark.table("b_scores"))
        joined = resume.attach_scores(spark.table("b_comments"), spark.table("b_scores"))
        assert "Exchange" not in plan(left) and "Exchange" not in plan(joined)
        assert left.count() == 150 and joined.filter("label = 'x'").count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE b_comments")
        spark.sql("DROP TABLE b_scores")


def test_scratch_is_below_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    one, two = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert one.startswith(base + "/x-") and one != two


def test_from_landed_pages_to_the_report(spark, folder):
    """Search pages and trees on disk, then collection, cleaning, scoring and the rate table."""
    pages = write_lines(folder, "search", [
        {"persoon": "sven", "query_index": 0, "data": {"children": [
            {"data": {"permalink": "/r/sports/a", "title": "Sven KRAMER wins", "subreddit": "sports",
                      "id": "a", "score": 5}},
            {"data": {"permalink": "/r/sports/b", "title": "Race day", "subreddit": "sports",
                      "id": "b", "score": 50}}]}}])
    trees = write_lines(folder, "threads", [
        document("a", node("1", "terrible race", listing(node("2", "great race", author="u"))),
                 node("3", "beep", author="AutoModerator")),
        document("b", node("4", "sven kramer was the worst"), node("5", "nice day"))])
    table = flows.collect_comments(landed.read_thread_listing(spark, pages),
                                   landed.read_comment_trees(spark, trees), SKATERS)
    sinks.write_comments(table, folder + "/comments", "csv")
    raw = landed.with_order(landed.read_comments(spark, folder + "/comments", "csv"))
    assert sorted(values(raw, "comment_id")) == ["1", "2", "3", "4"]
    sinks.write_split(clean.tag(raw), folder + "/clean")
    kept = sinks.read_kept(spark, folder + "/clean")
    flagged = clean.kept(clean.tag(raw), entity_frame(spark, SKATERS))
    assert {r.comment_id: r.name_in_comment for r in flagged.collect()} == {
        "1": False, "2": False, "4": True}
    rate = report.negative_rate(score.negative_flag(kept)).collect()
    assert [tuple(r) for r in rate] == [("sven", "man", 3, 2, 66.7)]


# --- Streams ---------------------------------------------------------------------------------------

STREAM = "comment_id string, persoon string, comment string, at timestamp"


def land(spark, path, rows):
    spark.createDataFrame([(*r, None) for r in rows], STREAM).write.mode("append").parquet(path)


def run(spark, folder, transform):
    stream = incremental.read_landed(spark, folder + "/in", STREAM, files_per_batch=1)
    incremental.run_available(transform(stream), folder + "/out", folder + "/progress")
    return sorted((r.comment_id, r.persoon) for r in spark.read.parquet(folder + "/out").collect())


def test_a_run_takes_only_what_is_new(spark, folder):
    land(spark, folder + "/in", [("1", "sven", "a"), ("1", "jutta", "a")])
    assert run(spark, folder, lambda s: s) == [("1", "jutta"), ("1", "sven")]
    assert run(spark, folder, lambda s: s) == [("1", "jutta"), ("1", "sven")]
    land(spark, folder + "/in", [("2", "sven", "b")])
    assert run(spark, folder, lambda s: s) == [("1", "jutta"), ("1", "sven"), ("2", "sven")]


def load_length_model():
    return lambda texts, labels: [(c[0], len(t) / 10) for t, c in zip(texts, labels)]


def test_a_batch_model_scores_a_stream(spark, folder):
    land(spark, folder + "/in", [("1", "sven", "abc"), ("2", "jutta", None)])

    def scored(stream):
        rows = stream.withColumn("candidate_labels", M.about_labels(F.col("persoon")))
        best = score.batch_score(rows, load_length_model, resume.SCORE_KEY)
        return best.withColumn("label", rules.relevance_two_way(F.col("best_label"), F.col("model_score")))

    assert run(spark, folder, scored) == [("1", "sven"), ("2", "jutta")]
    out = {r.comment_id: (r.model_score, r.label) for r in spark.read.parquet(folder + "/out").collect()}
    assert out == {"1": (0.3, "NOT_RELEVANT"), "2": (0.0, "NOT_RELEVANT")}


def test_each_key_once_over_all_runs(spark, folder):
    land(spark, folder + "/in", [("1", "sven", "a")] * 50 + [("1", "jutta", "a")])
    assert run(spark, folder, incremental.unique) == [("1", "jutta"), ("1", "sven")]
    land(spark, folder + "/in", [("1", "sven", "again"), ("2", "sven", "b"), ("2", "sven", "b")])
    assert run(spark, folder, incremental.unique) == [("1", "jutta"), ("1", "sven"), ("2", "sven")]


def test_watermarked_dedupe(spark, folder):
    rows = [(str(i % 4), "sven", "x") for i in range(12)]
    spark.createDataFrame(rows, "comment_id string, persoon string, comment string").withColumn(
        "at", F.lit("2024-01-01").cast("timestamp")).write.parquet(folder + "/in")
    got = run(spark, folder, lambda s: incremental.unique(s, event_time="at", delay="1 hour"))
    assert got == [(str(i), "sven") for i in range(4)]


def test_stream_dedupe_stays_in_the_engine(spark, folder):
    land(spark, folder + "/in", [("1", "sven", "a")])
    stream = incremental.read_landed(spark, folder + "/in", STREAM)
    for frame in (incremental.unique(stream), incremental.unique(stream, event_time="at", delay="1 hour")):
        text = plan(frame)
        assert "Python" not in text and "Arrow" not in text and "InPandas" not in text


def test_a_flood_of_copies_is_spread(spark, folder):
    for _ in range(4):
        land(spark, folder + "/in", [("1", "sven", "a")] * 500 + [("2", "sven", "b")])
    assert run(spark, folder, incremental.unique) == [("1", "sven"), ("2", "sven")]


def test_missing_shared_folder_stops_a_cluster_job(spark, monkeypatch):
    class Conf:
        @staticmethod
        def get(key, default):
            return default

    class Context:
        master = "spark://head:7077"

    class Cluster:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Cluster, "x")
