"""Chat formatting: templates read back, folded logs, digests against plain strings."""

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gabble.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, piece long, whole boolean, seq int, kind string"
BITS = [*chat_format.CONTROL, "\\", "\n", "a", "é😀", " word", "<", "/s>", "<\\s>", "INST]"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, True, 2, "k") for r in rows], SCHEMA).repartition(5)


def by_hand(rows):
    convs = {}
    for conv, turn, role, text in rows:
        digest = hashlib.sha256((text or "").encode()).hexdigest()
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", digest, text or ""))
    out = []
    for conv, said in convs.items():
        said = [(t[2], t[4]) for t in sorted(said)]
        loss = "".join(text for role, text in said if role == "assistant")
        out.append((conv, len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat_format.render(r, t)[0]) for r, t in said)))
    return sorted(out, key=str)


@given(st.lists(st.tuples(st.sampled_from(["assistant", "user", "", *BITS]), st.lists(st.sampled_from(BITS)).map("".join))))
def test_rendered_turns_read_back(said):
    assert list(chat_format.turns("".join(chat_format.render(*t)[0] for t in said))) == said


@given(st.lists(st.sampled_from(BITS)).map("".join))
def test_escaped_texts_hold_no_control_string(text):
    escaped = chat_format.escape(text)
    assert not any(c in escaped for c in chat_format.CONTROL) and chat_format.unescape(escaped) == text


@pytest.mark.parametrize("piece", [chat_format.PIECE, 300])
def test_digests(spark, piece):
    draw = random.Random(1)
    rows = [(7, 1, "user", "again")] * 3 + [(8, 0, "assistant", "long " * 100_000)]
    for conv in [None, -7, *range(20)]:
        for turn in range(draw.choice([1, 2, 5, 150])):
            text = "".join(draw.choices(BITS, k=draw.choice([0, 3, 20, 900])))
            rows.append((conv, draw.choice([turn, None, 3]), draw.choice(["user", "assistant", None, "a[ROLE]b"]), draw.choice([text, None])))
    out = chat_format.digests(chat_format.formatted(chat_format.logged(frame(spark, rows)), piece=piece))
    assert sorted([tuple(r) for r in out.collect()], key=str) == by_hand(rows)


def test_events_fold_to_the_final_text(spark):
    log = spark.createDataFrame([
        (1, 0, 0, "open", "user", None), (1, 0, 1, "delta", None, "Helo"), (1, 0, 9, "edit", None, "Hello"),
        (1, 1, 2, "open", "assistant", None), (1, 1, 3, "delta", None, "Bad"), (1, 1, 4, "regenerate", None, None),
        (1, 1, 5, "delta", None, "Good "), (1, 1, 6, "delta", None, None), (1, 1, 7, "delta", None, "day</s>"),
        (2, 0, 0, "delta", None, "no role"), (2, 1, 1, "open", "assistant", None)],
        "conv_id long, message int, seq int, kind string, role string, text string").repartition(4)
    out = {r["conv_id"]: r for r in chat_format.formatted(log, ("message",)).collect()}
    assert out[1]["text"] == r"[INST]user[ROLE]Hello[/INST]<s>Good day<\/s></s>"
    assert [out[1]["text"][s["start"]:s["end"]] for s in out[1]["spans"]] == [r"Good day<\/s>"]
    assert out[2]["text"] == "[INST][ROLE]no role[/INST]<s></s>"


def test_unknown_events_stop_the_job(spark):
    log = spark.createDataFrame([(1, 0, 0, "close", None, None)],
                                "conv_id long, message int, seq int, kind string, role string, text string")
    with pytest.raises(Exception, match="unknown kind of event"):
        chat_format.formatted(log, ("message",)).collect()


def test_derived_logs_hold_drafts(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], "some text " * 90) for c in range(40) for t in range(2)]
    kinds = {r["kind"]: r["count"] for r in chat_format.logged(frame(spark, rows)).groupBy("kind").count().collect()}
    assert kinds["open"] == 80 and kinds["delta"] > 160 and kinds["edit"] and kinds["regenerate"]


def test_empty_table(spark):
    assert chat_format.digests(chat_format.formatted(chat_format.logged(frame(spark, [])))).collect() == []


def test_a_conversation_with_a_third_of_all_rows_spreads(spark):
    rows = [(c, t, "user", f"text {t}") for c in range(1000) for t in range(2)] + [(5000, t, "user", "x" * 50) for t in range(1000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so little is put together again
    try:
        pieces = chat_format.formatted(chat_format.logged(frame(spark, rows))).where("conv_id = 5000").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(pieces) > 1 and sum(len(list(chat_format.turns(p["text"]))) for p in pieces) == 1000
