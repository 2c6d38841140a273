"""Hashes of words in arrays, buckets and batches of line dedup, and its whole result on a table."""

import hashlib
import random
import re

import numpy as np

import __spark_entry__ as entry
from gabble.llm import winnow
from tests.llm import data
from tests.llm.test_operators import FOLDER, brute_lines
from tests.llm.test_passages import brute


def slow_cut(text, gone, dropped):
    """Text and number of words cut beyond the lines that are gone, word by word."""
    left, at, n = [], 0, 0
    for k, line in enumerate(text.split("\n")):
        count = len(line.encode().split())
        marks, at = [i in dropped for i in range(at, at + count)], at + count
        if k in gone:
            continue
        n += sum(marks)
        if marks and all(marks):
            continue
        marks = iter(marks)
        left.append(re.sub(r"[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*", lambda m: "" if next(marks) else m[0], line))
    return "\n".join(left), n


def test_equal_words_have_equal_hashes():
    rng = random.Random(3)
    parts = ["".join(rng.choice("abé字 \n\t\r") for _ in range(rng.randrange(300))).encode() for _ in range(200)]
    parts += [b"x" * (2 * winnow.BLOCK) + b" y " + b"z" * winnow.BLOCK, b"z" * winnow.BLOCK, b"", b"z" * (winnow.BLOCK - 1)]
    whole = b"\n".join(parts) + b"\n"
    hashes, starts = winnow.hashed(np.frombuffer(whole, np.uint8))
    words = whole.split()
    assert [whole[a:a + len(w)] for a, w in zip(starts.tolist(), words)] == words
    pairs = set(zip(words, hashes.tolist()))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_cut_equals_a_slow_cut():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("ab é\n \t\r\x0b ") for _ in range(rng.randrange(60)))
        n, lines = len(text.encode().split()), text.count("\n") + 1
        cuts = [(a, min(n, a + rng.randrange(1, 6))) for a in (rng.randrange(n) for _ in range(rng.randrange(4)))] if n else []
        spans = [(a, min(lines - 1, a + rng.randrange(3))) for a in (rng.randrange(lines) for _ in range(rng.randrange(3)))]
        want = slow_cut(text, {k for a, b in spans for k in range(a, b + 1)}, {k for c in cuts for k in range(*c)})
        assert winnow.cut(text, spans, cuts) == want


def test_many_buckets_and_batches(spark, monkeypatch):
    """Passages that batches share, groups of copies, and rows that repeat an id, in batches of seven texts."""
    rng = random.Random(31)
    pool = [" ".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(4, 20))) for _ in range(30)]
    texts = {i: " ".join(rng.sample(pool, rng.randrange(1, 5))) for i in range(120)}
    texts |= {200 + i: texts[5] for i in range(60)}
    monkeypatch.setattr(winnow, "PER_BUCKET", 300)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = data.frame(spark, [*texts.items(), *((3, texts[3]) for _ in range(20))]).repartition(3)
        got = {r.doc_id: {k for c in r.cuts for k in range(c["first"], c["end"])} for r in winnow.passages(rows, min_words=6).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert got == {i: w for i, w in brute(texts, 6).items() if w}


def test_whole_result_on_the_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text or "" for r in rows}
    gone, dropped = brute_lines(texts, winnow.MIN_WORDS), brute(
        {i: t.encode() for i, t in texts.items()}, winnow.MIN_WORDS)
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.n_cut_words, r.kept_sha256) for r in entry.queries()["op8_line_dedup"](spark, FOLDER).collect()}
    want = {}
    for i, text in texts.items():
        left, n = slow_cut(text, gone[i], dropped[i])
        want[i] = (text.count("\n") + 1, len(gone[i]), n, hashlib.sha256(left.encode()).hexdigest())
    assert got == want
