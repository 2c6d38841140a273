"""Hand-made documents: nulls, empty and long texts, repeated rows, extra columns with clashing names."""

import base64

import public_tokenizers
import tiktoken

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp long, row_key long, part long, "
          "value string, score double, kept boolean, window long, label int, bucket_len int, next_text string, "
          "digest string, votes string, path string, h long, _id long")

LONG = " ".join(f"word{i % 997}x{i * i % 1009}" for i in range(30_000))
TEXTS = [
    (0, "The and attion to thanedble the, anea. Eriner thanea.\nAnat with by of nteres atre are the rest of it all."),
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, LONG), (6, "x" * 30_000), (7, "a b a b a b a b a b a b a b a b"),
    (8, 'Intro words here.\ntoken = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" and 9807915762804490 after'),
    (9, "Ünï çödé 字漢字 😀 ١٢٣  double  space\r\nnext line"), (None, "A text without an id, of a few plain words."),
    (10, "The and attion to thanedble the, anea. Eriner thanea.\nAnat with by of nteres atre are the rest of it all."),
    (10, "The and attion to thanedble the, anea. Eriner thanea.\nAnat with by of nteres atre are the rest of it all."),
    (11, "Something else under the same id, eleven words in one line here."), (11, "Another text under that id."),
]


def frame(spark, texts):
    rows = [(i, t, "en" if i != 4 else None, f"src{(i or 0) % 2}" if i != 5 else None, None, 1, 2, 3, "v", 0.5, True, 4, 1, 9,
             "n", "d", "x", "docs/test.md", 5, 6) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def edge(spark):
    return frame(spark, TEXTS).repartition(3)


def empty(spark):
    return frame(spark, [])


def reference_encoding():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
