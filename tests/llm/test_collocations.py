"""Collocations against counts over plain lists of words; the parsing by itself."""

import random
import re
from collections import Counter

import pytest

from gabble.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "lang string, text string, n long, f long, phrase string, chunk string, owned int, size int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "p", "c", 3, 4) for r in rows], SCHEMA).repartition(5)


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER))]


def by_hand(rows, max_words=3, least=10, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for words in pieces(text):
            totals[lang or "und"] += len(words)
            own.update(tuple(words[i:i + k]) for k in range(1, max_words + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            for part in {p[i:i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1)}:
                around[part] = max(around[part], a)
        ranked = []
        for p, a in candidates.items():
            if 100 * around[p] < 50 * a:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def some():
    draw = random.Random(2)
    words, gaps = ["A", "b", "c", "é", "Dd", "e", "the", "of", "ÀB"], [" ", " ", "  ", "\t", ". ", "\n", "!", ":x ", "\r\n", "\x0b"]
    rows = [(draw.choice(["en", "de", None]), "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.choice([0, 1, 5, 300]))))
            for _ in range(60)]
    return rows + [("en", None), ("fr", ""), ("fr", " \t.\n"), ("xx", "a " * 20_000), ("yy", "p q r s. " * 40), ("yy", "p q. " * 5)] + rows[:9]


@pytest.mark.parametrize("max_words", [2, 3, 5])
def test_phrases(spark, max_words):
    found = collocations.mine(frame(spark, some()), max_words=max_words)
    assert sorted(tuple(r) for r in found.collect()) == by_hand(some(), max_words)


def test_top_and_least(spark):
    found = collocations.mine(frame(spark, some()), min_count=3, top=7)
    assert sorted(tuple(r) for r in found.collect()) == by_hand(some(), least=3, top=7)


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_bitmap", lambda found: found.sparkSession.sparkContext.broadcast(b"\xff" * 8))
    assert sorted(tuple(r) for r in collocations.mine(frame(spark, some())).collect()) == by_hand(some())


def test_empty_table(spark):
    assert collocations.mine(frame(spark, [])).collect() == []


@pytest.mark.parametrize("trigger", [1, 2, 7, 1 << 40])
def test_chunks_own_every_start_once(trigger):
    rows = some()
    table = collocations.parse([r[0] or "und" for r in rows], [(r[1] or "").encode() for r in rows], 3, trigger)
    found, real = Counter(), Counter()
    for row in table.to_pylist():
        words = row["chunk"].split(" ")
        for i in range(row["owned"]):
            found[row["lang"], tuple(words[i:i + 3])] += row["n"]
    for lang, text in rows:
        for words in pieces(text):
            real.update((lang or "und", tuple(words[i:i + 3])) for i in range(len(words)))
    assert found == real


def test_equal_passages_share_chunks():
    words = [f"w{i * i % 997}" for i in range(400)]
    one, two = (set(collocations.parse(["en"], [" ".join(x).encode()]).column("chunk").to_pylist())
                for x in (["before", *words], [*words, "after", "it"]))
    assert len(one & two) >= min(len(one), len(two)) - 2


def test_large_counts_are_exact(spark):
    big = 3_000_000_000
    rows = [("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big)]
    found = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, size int, f long"), 2).first()
    assert found["score"] == 1_000_000 * big * big // ((big + 1) * big)
