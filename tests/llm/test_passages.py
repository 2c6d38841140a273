"""Repeated passages that start or end inside a line, against a definition by words."""

import random

from gabble.llm import winnow
from tests.llm import data


def brute(texts, least):
    """Words of each text that lie in a run of ``least`` words that occurs earlier."""
    seen, out = set(), {}
    for key in sorted(texts):
        parts = texts[key].split()
        out[key] = set()
        for a in range(len(parts) - least + 1):
            run = tuple(parts[a:a + least])
            if run in seen:
                out[key] |= set(range(a, a + least))
            seen.add(run)
    return out


def test_passages_equal_brute_force(spark):
    rng = random.Random(21)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 16))) for _ in range(12)]
    texts = {i: "".join(rng.choice(pool) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randrange(1, 8))) for i in range(80)}
    want = {i: w for i, w in brute(texts, 6).items() if w}
    rows = data.frame(spark, texts.items()).repartition(4)
    got = {r.doc_id: {k for c in r.cuts for k in range(c["first"], c["end"])} for r in winnow.passages(rows, min_words=6).collect()}
    assert want and got == want


def test_a_passage_inside_lines_is_cut(spark):
    passage = "this passage of eleven words stands in the middle of lines"
    texts = [(1, f"First begin {passage} first end.\nKept."), (2, f"Second start {passage} second end.\nKept too.")]
    left = {r.doc_id: r.text for r in winnow.clean(data.frame(spark, texts)).collect()}
    assert left == {1: texts[0][1], 2: "Second start second end.\nKept too."}
    assert {r.doc_id: (r.n_deleted, r.n_cut_words) for r in winnow.report(data.frame(spark, texts)).collect()} == {1: (0, 0), 2: (0, 11)}
    broken = [(1, passage), (2, "Other " + passage.replace("words ", "words\n"))]
    left = {r.doc_id: r.text for r in winnow.clean(data.frame(spark, broken)).collect()}
    assert left == {1: passage, 2: "Other "}


def test_periodic_texts_equal_brute_force(spark):
    """Phrases that repeat over and over in one line, of one to twelve words."""
    texts = {p: " ".join(f"w{k % p}" for k in range(60)) for p in range(1, 13)}
    texts |= {20: "start " + "buy now " * 50 + "end", 21: "click here to win now " * 40, 22: "a b c d e f " * 40}
    want = {i: w for i, w in brute(texts, 10).items() if w}
    rows = data.frame(spark, texts.items()).repartition(4)
    got = {r.doc_id: {k for c in r.cuts for k in range(c["first"], c["end"])} for r in winnow.passages(rows).collect()}
    assert got == want
