"""Word shapes and quantities of the quality scorer, against their definition word by word."""

import random
import re

from gabble.llm import quality

CHARACTERS = "abZÉß字İΣσς9٣_ \n\t\x1c\x85  .!?،ǅ-’\U0001D400"


def slow_shape(word):
    kinds = re.sub(r"\d", "9", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", word))
    return re.sub(r"(.)\1+", r"\1+", kinds)


def words_of(rng, n):
    return ["".join(rng.choice(CHARACTERS) for _ in range(rng.randrange(1, 12))).strip() or "x" for _ in range(n)]


def test_shapes_are_those_of_the_definition():
    words = [w for part in words_of(random.Random(6), 3000) for w in part.split()]
    words += [f"x{chr(k)}Y" for k in range(0x3000) if not chr(k).isspace()]
    for word in words:
        assert quality.word_features(word) == ["w:" + word.lower(), "s:" + slow_shape(word)]


def test_quantities_are_those_of_the_definition():
    rng = random.Random(7)
    for _ in range(2000):
        text = " ".join(words_of(rng, rng.randrange(12)) + rng.choice([[], ["The", "THE!", "und", "für;"]]))
        words, values = quality.properties(text)
        n = max(len(words), 1)
        assert words == text.split()
        assert values[1] == sum(w.isupper() and len(w) > 1 for w in words) / n
        assert values[2] == sum(a == b for a, b in zip(words, words[1:])) / n
        assert values[4] == sum(len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum() for w in words) / n
        assert values[8] == sum(w.lower().strip(".,;:!?") in quality.FUNCTION_WORDS for w in words) / n


def test_a_shape_is_looked_at_once(monkeypatch):
    """A task meets millions of words but few shapes and characters; neither goes through a pattern again."""
    quality.word_features("Straße1234")
    monkeypatch.setattr(quality, "_AGAIN", None)
    monkeypatch.setattr(quality, "_LETTER", None)
    monkeypatch.setattr(quality, "_DIGIT", None)
    assert quality.word_features("Steaße1243") == ["w:steaße1243", "s:Aa+9+"]
