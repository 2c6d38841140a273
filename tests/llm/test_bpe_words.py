"""The codec's work on distinct words and runs of ids: what it sends to its queries, and where it may cut."""

from itertools import product

import numpy as np
import public_tokenizers
import pytest

from gabble.llm import bpe
from tests.llm import data

WORDS = ["sttible", "erberheit,", "geung.\nOnly", "ñezñra", "9807915762804490", "字漢字😀", "\x00nul\x00"]


@pytest.fixture
def codec():
    return bpe.Codec(data.RANKS, public_tokenizers.PATTERN)


def watch(codec):
    sent, query = [], codec._query

    def counted(name, rows, sql):
        sent.append((name, rows.num_rows))
        return query(name, rows, sql)

    codec._query = counted
    return sent


def test_repeated_runs_are_decoded_once(codec):
    texts = [" ".join(WORDS[(i * i + k) % 7] for i in range(4000)) for k in range(3)]
    ids = codec.encode(texts)
    sent = watch(codec)
    assert codec.decode(ids) == [t.encode() for t in texts]
    assert sum(n for name, n in sent if name == "ids") < 500 < sum(map(len, ids)) / 100


def test_texts_with_wide_space_are_encoded_by_distinct_words(codec):
    text = "  \n\t ".join(" ".join(WORDS) for _ in range(500)) + "  "
    called, pattern = [], codec.pattern

    class Watched:
        def findall(self, part):
            called.append(len(part))
            return pattern.findall(part)

    codec.pattern = Watched()
    assert codec.encode([text])[0].tolist() == data.reference_encoding().encode_ordinary(text)
    assert sum(called) < 300


def test_every_short_text_is_cut_like_the_library_does(codec):
    texts = ["".join(t) for n in range(6) for t in product(" \n\x1c\xa0a.", repeat=n)]
    texts += ["b" + t + " c" for t in texts if len(t) < 5]
    tokens = data.reference_encoding()
    ids = codec.encode(texts)
    assert [x.tolist() for x in ids] == [tokens.encode_ordinary(t) for t in texts]
    assert [x.tolist() for t in texts[:300] for x in codec.encode([t])] == [x.tolist() for x in ids[:300]]
    assert codec.decode(ids) == [t.encode() for t in texts]
    assert [bytes(x) for x in codec.written(ids)] == [" ".join(map(str, x.tolist())).encode() for x in ids]


def test_unknown_ids_have_no_bytes(codec):
    a, b = codec.encode([" one two", "three"])
    strange = np.array([-5, *a.tolist(), 2_000_000_000, 60_000], np.int32)
    none = np.array([], np.int32)
    assert codec.decode([strange, none, b, np.array([-1, 70_000], np.int32)]) == [b" one two", b"", b"three", b""]
    assert codec.decode([none]) == [b""] and codec.decode([]) == [] and codec.encode([]) == [] and codec.encode([""])[0].size == 0


def test_forgotten_words_are_encoded_again(codec, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "QUERY_IDS", 50)
    tokens = data.reference_encoding()
    texts = [" ".join(f"w{i % 13}x{i * k % 31}" for i in range(40)) for k in range(12)]
    for part in (texts[:5], texts[5:], texts):
        ids = codec.encode(part)
        assert [x.tolist() for x in ids] == [tokens.encode_ordinary(t) for t in part]
        assert codec.decode(ids) == [t.encode() for t in part]
    assert len(codec.new) + len(codec.old) < 1000


def test_only_the_pieces_of_long_words_are_remembered(codec):
    texts = ["  ".join("字漢,".join(f"{i}{k}ü" for i in range(60)) for k in range(20))] * 2
    tokens = data.reference_encoding()
    for _ in range(2):
        assert [x.tolist() for x in codec.encode(texts)] == [tokens.encode_ordinary(t) for t in texts]
    assert max(map(len, codec.new)) <= bpe.LONG
