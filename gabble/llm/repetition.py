"""Quality rules by suffix-array repetition.

A suffix array over the words of many texts at once (each suffix belongs to its own text) is built by
prefix doubling that sorts only suffixes still tied. Neighbouring suffixes give the longest common
prefixes. The deepest longest-common-prefix interval around a suffix is the longest passage that starts
there and occurs again; the union of these spans is the union of all maximal repeated passages.

A text fails if its repeated passages of ``min_repeat`` words or more cover over ``max_covered`` of its
words, if one of them has more than ``max_longest`` words, or if the text has under ``min_words`` words.

Edge cases: a null or empty text has no words and fails; repeated rows get equal results, row by row;
an empty table gives an empty result; a text of one word repeated is one repeat that overlaps itself;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gabble.llm.common import SPACES, chunks, words

SYMBOLS = "#*$%&|<>"
#: Words whose suffixes are sorted together; bounds the memory of a task. A longer text stands alone.
CHUNK_WORDS = 100_000


@dataclass(frozen=True)
class Limits:
    min_words: int = 10
    min_repeat: int = 5
    max_covered: float = 0.20
    max_longest: int = 50


def longest_repeats(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each position the length of the longest passage that starts there and occurs twice or more.

    ``symbols`` are the word numbers of all texts in a row, ``owner`` the number of each word's text.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    key = owner.astype(np.int64) * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    slots = np.arange(n)
    head = np.maximum.accumulate(np.where(fresh, slots, 0))
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = head
    last = np.append(fresh[1:], True)
    tied = np.flatnonzero(~(fresh & last))  # slots of the suffix array that are not settled
    levels = [rank.astype(np.int32)]
    near = np.append(owner, -1)
    step = 1
    first_order, first_fresh = order.copy(), fresh
    while len(tied):
        at = order[tied]
        ahead = np.minimum(at + step, n)
        second = np.where(near[ahead] == owner[at], rank[ahead], -1)
        key = rank[at] * (n + 2) + second + 1
        turn = np.argsort(key, kind="stable")
        order[tied] = at[turn]
        key = key[turn]
        new = np.empty(len(tied), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        levels.append(rank.astype(np.int32))
        step *= 2
    same = np.flatnonzero(~first_fresh[1:]) + 1  # neighbours whose first word is equal
    left, right = order[same - 1].copy(), order[same].copy()
    starts = left.copy(), right.copy()
    length = np.zeros(len(same), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels[level]
        equal = ranks[left] == ranks[right]
        grow = np.where(equal, 1 << level, 0)
        length += grow
        left = np.minimum(left + grow, n)
        right = np.minimum(right + grow, n)
    best = np.zeros(n, np.int64)
    np.maximum.at(best, starts[0], length)
    np.maximum.at(best, starts[1], length)
    return best


def repeated_words(lists: list[list[bytes]], min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: words inside repeated passages, and the longest repeated passage."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    total = int(sizes.sum())
    if not total:
        return np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
    number: dict[bytes, int] = {}
    symbols = np.fromiter((number.setdefault(w, len(number)) for ws in lists for w in ws), np.int64, total)
    owner = np.repeat(np.arange(len(lists)), sizes)
    best = longest_repeats(symbols, owner)
    longest = np.zeros(len(lists), np.int64)
    np.maximum.at(longest, owner, best)
    at = np.flatnonzero(best >= min_repeat)
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + best[at], -1)
    covered = np.bincount(owner, np.cumsum(edge[:-1]) > 0, len(lists)).astype(np.int64)
    return covered, longest


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    count = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            count += line in seen
            seen.add(line)
    return count


RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "longest_repeat long, base_failed boolean, kept boolean")


def judge(texts: list[str | None], limits: Limits) -> Iterator[dict[str, np.ndarray]]:
    """Columns of :data:`RESULT` for runs of texts, in order."""
    texts = [t or "" for t in texts]
    for start, end in chunks((len(t) // 5 for t in texts), CHUNK_WORDS):
        part = texts[start:end]
        lists = [words(t) for t in part]
        covered, longest = repeated_words(lists, limits.min_repeat)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        failed = (n < limits.min_words) | (100 * covered > round(100 * limits.max_covered) * n)
        yield {
            "n_words": n,
            "word_chars": np.array([len(t) - sum(map(t.count, SPACES)) for t in part], np.int64),
            "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in part], np.int64),
            "n_dup_lines": np.array([repeated_lines(t) for t in part], np.int64),
            "n_repeat_words": covered,
            "longest_repeat": longest,
            "base_failed": failed,
            "kept": ~failed & (longest <= limits.max_longest),
        }


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
          limits: Limits = Limits()) -> DataFrame:
    """One row per document with its counts and verdicts."""

    def run(batches):
        for batch in batches:
            ids, at = batch.column(0), 0
            for columns in judge(batch.column(1).to_pylist(), limits):
                size = len(columns["kept"])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, size), *map(pa.array, columns.values())], names=["doc_id", *columns])
                at += size

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(
        run, f"doc_id {kind}, {RESULT}")


def keep(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with all their columns, in one pass over the table."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            verdicts = [c["kept"] for c in judge(texts, limits)]
            if verdicts:
                yield batch.filter(pa.array(np.concatenate(verdicts)))

    return docs.mapInArrow(run, docs.schema)
