"""Line dedup by winnowing over line hashes.

A text is a sequence of line hashes. For each line, the shortest run of lines that starts there and the
shortest that ends there with ``min_words`` words form two windows. A window elects its smallest line hash
as fingerprint. Equal windows elect equal fingerprints, so every run of ``min_words`` words that two texts
share is guaranteed to share one. Positions of fingerprints that a second text also has are joined, checked
by the hash of the whole window, and extended: the windows that start or end around a match carry it on to
both sides, line by line, to the full length of the repeated run.

Result, exactly: a line is deleted if it lies in a run of lines with ``min_words`` words or more that also
occurs earlier, in a text with a smaller id or further up in the same text. Lines are equal if their words
are. The first occurrence of each run stays.

Passages that start or end inside a line, or have other line breaks, are found by words. A text's words are a
sequence of hashes; of the ``GRAM``-word hashes inside each window of ``min_words`` words the smallest is elected, so
that equal windows elect equal hashes. Only elected hashes leave the tasks, as arrays by bucket, each once per batch of
texts. Texts with a hash that stands at two places are read again: the windows that elected it are compared by that hash
and a second one of the whole window, and those that occur earlier overlap to the full length of the passage, on both
sides, word by word. The number of buckets grows with the bytes of text.

So exactly: a word outside deleted lines is cut if it lies in a run of ``min_words`` words or more that also
occurs earlier. A line of which no word is left goes too.

Edge cases: null or empty texts have no runs and stay as they are; a null id counts as smaller than all
others; rows that repeat an id with another text are ordered by text hash, and of equal rows all stay or
none, as they are one text; an empty table gives an empty result. Other columns pass through ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gabble.llm.common import by_id, chunks, row_key, text_of
from gabble.session import written

#: Words in a run of lines from which on a repetition is deleted.
MIN_WORDS = 10

#: Words of an elected hash.
GRAM = 5
#: Bytes of text that a bucket of hashes stands for; a bucket's arrays take about the same.
PER_BUCKET = 32 << 20
#: Bytes of text that are hashed at a time.
BLOCK = 1 << 18

_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([k])) for k in range(256)], np.uint64)
_POWERS = np.cumprod(np.full(BLOCK + 1, 0x9E3779B97F4A7C15, np.uint64))
_INVERSES = np.cumprod(np.full(BLOCK + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))

WINDOWS = "doc_id long, row_key long, fingerprint long, window long, first int, last int, again boolean"


def windows(text: str, min_words: int) -> list[tuple[int, int, int, int, bool]]:
    """(fingerprint, window hash, first line, last line, occurs further up in this text)."""
    parts = [line.split() for line in text.encode().split(b"\n")]
    hashes = [xxhash.xxh3_64_intdigest(b" ".join(p)) - (1 << 63) for p in parts]
    before = [0, *accumulate(map(len, parts))]
    n, spans = len(parts), set()
    end = 0
    for start in range(n):
        end = max(end, start + 1)
        while end < n and before[end] - before[start] < min_words:
            end += 1
        if before[end] - before[start] < min_words:
            break
        if parts[start]:
            spans.add((start, end))
    start = n - 1
    for end in range(n, 0, -1):
        start = min(start, end - 1)
        while start > 0 and before[end] - before[start] < min_words:
            start -= 1
        if before[end] - before[start] < min_words:
            break
        if parts[end - 1]:
            spans.add((start, end))
    found, seen = [], set()
    for start, end in sorted(spans):
        own = [h for h, p in zip(hashes[start:end], parts[start:end]) if p]
        whole = own[0] if len(own) == 1 else xxhash.xxh3_64_intdigest(pack(f"{len(own)}q", *own)) - (1 << 63)
        found.append((min(own), whole, start, end - 1, whole in seen))
        seen.add(whole)
    return found


def _positions(docs: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(doc_id, text).alias("row_key"),
                         text_of(text).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("fingerprint", pa.int64()),
                        ("window", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("again", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows = []
            for i, key, body in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(i, key, *w) for w in windows(body, min_words)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return picked.mapInArrow(run, WINDOWS)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, row_key, spans``: for each text with repeated runs the (first, last) lines to delete."""
    found = written(_positions(docs, doc_id, text, min_words), "winnow")
    place = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place")
    # Texts are told apart by row key: many rows under one fingerprint shrink to two numbers per task.
    shared = (found.groupBy("fingerprint").agg(F.min("row_key").alias("a"), F.max("row_key").alias("b"))
              .where("a < b").select("fingerprint"))
    # Written, so that the join reads both sides from exchanges and Spark can split a frequent fingerprint.
    shared = written(shared, "shared")
    matched = (found.where("not again").join(shared, "fingerprint")
               .select("window", "doc_id", "row_key", "first", "last", place))
    matched = written(matched, "matched")
    sources = (matched.groupBy("window").agg(F.min("place").alias("source"), F.min("row_key").alias("a"),
                                             F.max("row_key").alias("b")).where("a < b").drop("a", "b"))
    sources = written(sources, "sources")
    tied = matched.join(sources, "window")
    # Texts under the smallest id: its first text hash is the source.
    first = (tied.where("place = source").groupBy("window").agg(F.min("row_key").alias("source_key"),
                                                               F.first("source").alias("source")))
    first = written(first, "first")
    later = (matched.join(first, "window")
             .where("place > source or (place = source and row_key > source_key)")
             .select("doc_id", "row_key", "first", "last"))
    later = later.unionByName(found.where("again").select("doc_id", "row_key", "first", "last"))
    return (later.groupBy("doc_id", "row_key")
            .agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans")))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _blank(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space: blanks, and 9 to 13 (smaller ones wrap to large numbers)."""
    return (data == 32) | (data - np.uint8(9) < 5)


def hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of some bytes that end in white space.

    A word's hash is a polynomial in its bytes, as a difference of running sums, so that no word becomes an object.
    """
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            blanks = np.flatnonzero(_blank(data[at:end]))
            if not len(blanks):  # a word longer than a block
                end += int(_blank(data[end:]).argmax())
                hashes.append(np.array([xxhash.xxh3_64_intdigest(data[at:end].tobytes())], np.uint64))
                starts.append(np.array([at]))
                at = end
                continue
            end = at + int(blanks[-1]) + 1
        block = data[at:end]
        edges = np.flatnonzero(np.diff(_blank(block), prepend=True, append=True))
        first, last = edges[0::2], edges[1::2]
        sums = np.zeros(len(block) + 1, np.uint64)
        terms = _BYTES.take(block)
        terms *= _POWERS[:len(block)]
        np.cumsum(terms, out=sums[1:])
        hashes.append(_mixed((sums[last] - sums[first]) * _INVERSES[first]))
        starts.append(first + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, int))


def _runs(one: np.ndarray, size: int, factor: int) -> np.ndarray:
    """A hash of each ``size`` words in a row."""
    n = max(len(one) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(factor)
        out += one[k:k + n]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def elected(texts: list[bytes], min_words: int, places: bool = False) -> tuple[np.ndarray, ...]:
    """Each window of ``min_words`` words: number of its text, the hash it elects (the leftmost of the smallest), its
    first word in the text, and the hash of the whole window. With ``places`` each elected place once: text and hash."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    one, starts = hashed(data)
    firsts = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    of = np.repeat(np.arange(len(texts)), np.diff(firsts))
    size, n = min(GRAM, min_words), max(len(one) - min_words + 1, 0)
    grams = _runs(one, size, 0x9E3779B97F4A7C15)
    least = _least(grams, min_words - size + 1)
    inside = of[:n] == of[len(of) - n:]  # not across two texts
    if places:  # one window for each: where the hash changes, or its leftmost place has gone
        moved = inside.copy()
        moved[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (grams[:n - 1] == least[:-1]) if n else True
        at = np.flatnonzero(moved)
        return of[at], least[at]
    at = np.flatnonzero(inside)
    # Its grams side by side, the last one at its end, cover a window.
    window = np.zeros(n, np.uint64)
    for k in (*range(0, min_words - size, size), min_words - size):
        window *= np.uint64(0xA0761D6478BD642F)
        window += grams[k:k + n]
        window ^= window >> np.uint64(32)
    window *= np.uint64(0xBF58476D1CE4E5B9)
    return of[at], least[at], at - firsts[of[at]], window[at]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row."""
    n, span = max(len(values) - width + 1, 0), 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:n], values[width - span:][:n])


def _groups(grams: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in an order that puts equal ones (in all arrays) together, and where each group starts there."""
    key = grams
    for k in others:
        key = key * np.uint64(0x9E3779B97F4A7C15) ^ k
    turn = np.argsort(key)
    new = np.diff(key[turn], prepend=~key[turn[:1]]) != 0
    whole = (grams, *others)
    if any(((c[turn][1:] != c[turn][:-1]) & ~new[1:]).any() for c in whole):  # two that differ share a key
        turn = np.lexsort(whole)
        new = np.ones(len(turn), bool)
        new[1:] = np.any([c[turn][1:] != c[turn][:-1] for c in whole], axis=0)
    return turn, np.flatnonzero(new)


def _by(values: np.ndarray, *columns: np.ndarray):
    """The distinct values, each with its part of the columns."""
    small = len(values) > 0 and 0 <= values.min() and values.max() < 1 << 16  # numbers of buckets sort faster as such
    order = np.argsort(values.astype(np.uint16) if small else values, kind="stable")
    values, columns = values[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.diff(values, prepend=~values[:1]))
    for a, b in zip(starts, [*starts[1:], len(values)]):
        yield values[a], *(c[a:b] for c in columns)


def _packed(buckets: np.ndarray, schema: pa.Schema, **columns: np.ndarray) -> pa.RecordBatch:
    """A row per bucket, with the other columns as bytes of arrays."""
    rows = [(int(b), *(p.tobytes() for p in parts)) for b, *parts in _by(buckets, *columns.values())]
    parts = dict(zip(["bucket", *columns], zip(*rows))) if rows else {}
    return pa.RecordBatch.from_arrays([pa.array(parts.get(f.name) or [None] * len(rows), f.type) for f in schema], schema=schema)


def _joined(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join([x.as_buffer() for x in column.drop_null()]), dtype)


def _chosen(n: int, rows: np.ndarray) -> np.ndarray:
    """Distinct row numbers below ``n`` in ascending order."""
    own = np.zeros(n, bool)
    own[rows] = True
    return np.flatnonzero(own)


#: Parts of a bucket that are sorted one after the other.
PARTS = 8


def _repeated(grams: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are equal to another one (in all arrays), group by group, and the sizes of the groups."""
    turns, sizes = [], []
    part = (_mixed(grams) >> np.uint64(32)) % np.uint64(PARTS)  # of equal ones the same
    part = part.astype(np.uint8)
    for k in range(PARTS):
        own = np.flatnonzero(part == k)
        turn, starts = _groups(grams[own], *(c[own] for c in others))
        n = np.diff(starts, append=len(turn))
        turns.append(own[turn[np.repeat(n > 1, n)]])
        sizes.append(n[n > 1])
    return np.concatenate(turns), np.concatenate(sizes)


def _texts(batch: pa.RecordBatch, order: np.ndarray):
    """Texts of a batch in an order, as bytes, some :data:`BLOCK` at a time, with the number of the first."""
    texts = batch.column("text").cast(pa.binary()).take(pa.array(order)).to_pylist()
    for a, b in chunks(map(len, texts), BLOCK):
        yield a, texts[a:b]


_MARKS = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("grams", pa.binary()), ("done", pa.binary())])
_PLACES = pa.schema([("bucket", pa.int64()), ("places", pa.binary()), ("keys", pa.binary()), ("firsts", pa.binary()),
                     ("grams", pa.binary()), ("windows", pa.binary())])
_CUTS = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()),
                   ("cuts", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))])


def _known(picked: DataFrame, buckets: int, min_words: int) -> DataFrame:
    """``row_key, grams``: for each text the elected hashes that stand at two places or more, anywhere, as bytes of an array.

    A task settles what its batch has twice by itself and sends each hash of a batch once, in arrays by bucket, so that a
    frequent hash reaches its bucket once per batch. What is settled is dealt again by text.
    """

    def mark(batches):
        for batch in batches:
            keys, found = batch.column("row_key").to_numpy(), []
            for start, texts in _texts(batch, np.arange(len(keys))):
                of, grams = elected(texts, min_words, places=True)
                found.append((grams, keys[start + of]))
            if not found:
                continue
            grams, keys = (np.concatenate(c) for c in zip(*found))
            turn, starts = _groups(grams)
            n = np.diff(starts, append=len(turn))
            twice = _chosen(len(turn), turn[np.repeat(n > 1, n)])  # by text, so that equal keys stand together and compress
            yield _packed(keys[twice] % buckets, _MARKS, keys=keys[twice], done=grams[twice])
            once = _chosen(len(turn), turn[starts[n == 1]])
            yield _packed((grams[once] % np.uint64(buckets)).view(np.int64), _MARKS, grams=grams[once], keys=keys[once])
            some = grams[turn[starts[n > 1]]]
            yield _packed((some % np.uint64(buckets)).view(np.int64), _MARKS, grams=some)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, keys, double = [], [], []
        for batch in batches:  # one after the other, so that no task holds a bucket's rows beside its arrays
            yield batch.filter(pc.is_valid(batch["done"]))
            lone = batch.filter(pc.and_(pc.is_valid(batch["grams"]), pc.is_valid(batch["keys"])))
            single.append(_joined(lone["grams"], np.uint64))
            keys.append(_joined(lone["keys"], np.int64))
            double.append(_joined(batch.filter(pc.and_(pc.is_valid(batch["grams"]), pc.is_null(batch["keys"])))["grams"], np.uint64))
        n_single, grams = sum(map(len, single)), np.concatenate([*single, *double])
        del single, double
        # One that was sent without a text stands at two places by itself.
        shared = _chosen(len(grams), _repeated(grams)[0])
        shared = shared[:np.searchsorted(shared, n_single)]
        keys = np.concatenate(keys)[shared]
        yield _packed(keys % buckets, _MARKS, keys=keys, done=grams[shared])

    def gather(table: pa.Table) -> pa.Table:
        rows = [(int(key), g.tobytes()) for key, g in _by(_joined(table["keys"], np.int64), _joined(table["done"], np.uint64))]
        keys, grams = zip(*rows) if rows else ([], [])
        return pa.table({"row_key": pa.array(keys, pa.int64()), "grams": pa.array(grams, pa.binary())})

    fields = "bucket long, keys binary, grams binary, done binary"
    marks = picked.select("row_key", "text").mapInArrow(mark, fields)
    return (marks.groupBy("bucket").applyInArrow(settle, fields)
            .groupBy("bucket").applyInArrow(gather, "row_key long, grams binary"))


def _later(picked: DataFrame, known: DataFrame, buckets: int, min_words: int) -> DataFrame:
    """``doc_id, row_key, cuts``: the windows that also occur earlier, merged.

    The windows around a joined position are those that elected it. A batch sends the earliest place of each; the others
    are later ones already. What is settled is dealt again by text.
    """

    def around(batches):
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy() for c in ("place", "row_key"))
            turn = np.lexsort((keys, ids))
            shared, found = batch.column("grams").take(pa.array(turn)).to_pylist(), []
            ids, keys = ids[turn], keys[turn]
            rank = np.concatenate([[True], (np.diff(ids) != 0) | (np.diff(keys) != 0)])[:len(ids)].cumsum() - 1  # equal rows are one text
            ids, keys = ids[np.diff(rank, prepend=-1) != 0], keys[np.diff(rank, prepend=-1) != 0]
            for start, texts in _texts(batch, turn):
                of, least, at, window = elected(texts, min_words)
                # A few others may pass; the windows themselves decide.
                own = np.zeros(1 << 20, bool)
                own[np.frombuffer(b"".join(shared[start:start + len(texts)]), np.uint64) & np.uint64(0xFFFFF)] = True
                kept = np.flatnonzero(own[least & np.uint64(0xFFFFF)])
                found.append((least[kept], window[kept], rank[of[kept] + start] << 32 | at[kept]))
            if not found:
                continue
            grams, windows, order = (np.concatenate(c) for c in zip(*found))
            if not len(order):
                continue
            turn, starts = _groups(grams, windows)
            head = np.minimum.reduceat(turn, starts)  # rows stand in the order of places
            late = order[turn] != np.repeat(order[head], np.diff(starts, append=len(turn)))
            late = order[_chosen(len(order), turn[late])]
            if (np.diff(late) <= 0).any():  # of equal rows
                late = np.unique(late)
            of = late >> 32
            yield _packed(keys[of] % buckets, _PLACES, places=ids[of], keys=keys[of], firsts=(late & 0xFFFFFFFF).astype(np.int32))
            head = _chosen(len(order), head)  # by text, so that equal keys stand together and compress
            grams, windows, of = grams[head], windows[head], order[head] >> 32
            yield _packed((grams % np.uint64(buckets)).view(np.int64), _PLACES, places=ids[of], keys=keys[of],
                          firsts=(order[head] & 0xFFFFFFFF).astype(np.int32), grams=grams, windows=windows)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"grams": np.uint64, "windows": np.uint64, "places": np.int64, "keys": np.int64, "firsts": np.int32}
        sent = {c: [np.zeros(0, t)] for c, t in kinds.items()}
        for batch in batches:  # one after the other, so that no task holds a bucket's rows beside its arrays
            yield batch.filter(pc.is_null(batch["grams"]))
            batch = batch.filter(pc.is_valid(batch["grams"]))
            for c, t in kinds.items():
                sent[c].append(_joined(batch[c], t))
        turn, n = _repeated(*(np.concatenate(sent.pop(c)) for c in ("grams", "windows")))
        ids, keys, at = (np.concatenate(sent.pop(c))[turn] for c in ("places", "keys", "firsts"))
        # The earliest place of each group stays.
        first = np.ones(len(turn), bool)
        for c in (ids, keys, at) if len(turn) else ():
            first &= c == np.repeat(np.minimum.reduceat(np.where(first, c, np.iinfo(c.dtype).max), np.cumsum(n) - n), n)
        late = np.flatnonzero(~first)
        late = late[np.argsort(keys[late])]
        yield _packed(keys[late] % buckets, _PLACES, places=ids[late], keys=keys[late], firsts=at[late])

    def merge(table: pa.Table) -> pa.Table:
        ids, keys, at = (_joined(table[c], t) for c, t in (("places", np.int64), ("keys", np.int64), ("firsts", np.int32)))
        turn = np.lexsort((at, keys, ids))
        ids, keys, at = ids[turn], keys[turn], at[turn]
        text = (np.diff(ids, prepend=~ids[:1]) != 0) | (np.diff(keys, prepend=~keys[:1]) != 0)
        starts = np.flatnonzero(text | (np.diff(at, prepend=at[:1]) > min_words))
        ends = np.append(starts[1:], len(at))[:len(starts)] - 1
        texts = np.flatnonzero(text)
        cuts = pa.StructArray.from_arrays([pa.array(at[starts]), pa.array(at[ends] + np.int32(min_words))], names=["first", "end"])
        bounds = pa.array(np.searchsorted(starts, np.append(texts, len(at))).astype(np.int32))
        least = -(1 << 63)
        return pa.Table.from_arrays([pa.array(ids[texts], mask=ids[texts] == least), pa.array(keys[texts]),
                                     pa.ListArray.from_arrays(bounds, cuts)], names=["doc_id", "row_key", "cuts"]).cast(_CUTS)

    fields = "bucket long, places binary, keys binary, firsts binary, grams binary, windows binary"
    places = picked.join(known, "row_key").select("place", "row_key", "text", "grams").mapInArrow(around, fields)
    return (places.groupBy("bucket").applyInArrow(settle, fields)
            .groupBy("bucket").applyInArrow(merge, "doc_id long, row_key long, cuts array<struct<first:int,end:int>>"))


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, row_key, cuts``: for each text with repeated passages the [first, end) words to cut."""
    place = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    picked = docs.select(place.alias("place"), row_key(doc_id, text).alias("row_key"), text_of(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_of(text)))).first()[0] or 0
    buckets = size // PER_BUCKET + 1
    known = written(_known(picked, buckets, min_words), "known")
    return _later(picked, known, buckets, min_words)


def cut(text: str, spans: list[tuple[int, int]], cuts: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the lines in ``spans`` and the words in ``cuts``, and how many words went beyond the lines.

    A word goes with the white space after it, up to the end of its line; a line of which no word is left goes whole.
    """
    data = np.frombuffer(text.encode() + b"\n", np.uint8)
    edges = np.flatnonzero(np.diff(_blank(data), prepend=True))
    starts, ends = edges[0::2], np.flatnonzero(data == 10)
    line = np.searchsorted(ends, starts)
    dropped = np.zeros(len(starts), bool)
    for a, b in cuts:
        dropped[a:b] = True
    gone = np.zeros(len(ends), bool)
    for a, b in spans:
        gone[a:b + 1] = True
    dropped &= ~gone[line]
    n_cut = int(dropped.sum())
    counts, lost = np.bincount(line, minlength=len(ends)), np.bincount(line[dropped], minlength=len(ends))
    gone |= (lost > 0) & (lost == counts)
    # What is left out, as steps up and down at its first byte and behind its last.
    steps = np.zeros(len(data) + 1, np.int8)
    dropped &= ~gone[line]
    steps[starts[dropped]] += 1
    steps[np.minimum(np.append(starts[1:], len(data)), ends[line])[dropped]] -= 1
    steps[np.append(0, ends[:-1] + 1)[gone]] += 1
    steps[ends[gone] + 1] -= 1
    left = data[np.cumsum(steps[:-1], dtype=np.int8) == 0].tobytes()
    return left[:-1].decode(), n_cut


def _left(docs: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    """``docs`` with ``_spans``, and ``_left``: what is left of the text, and the number of words cut inside lines."""
    keys = [doc_id, "_row_key"]
    spans = repeated_spans(docs, doc_id, text, min_words)
    cuts = passages(docs, doc_id, text, min_words)
    # One row per text, so that the texts are joined once.
    both = (spans.withColumn("cuts", F.lit(None).cast(cuts.schema["cuts"].dataType)).unionByName(
        cuts.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))
        .groupBy("doc_id", "row_key").agg(F.first("spans", True).alias("_spans"), F.first("cuts", True).alias("_cuts")))
    both = written(both.withColumnsRenamed({"doc_id": doc_id, "row_key": "_row_key"}), "repeats")
    joined = by_id(docs.withColumn("_row_key", row_key(doc_id, text)), both, keys)

    @F.pandas_udf("text string, n_cut long")
    def rest(body: pd.Series, spans: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        pairs = ([x.reshape(-1, 2).tolist() if x is not None else [] for x in c] for c in (spans, cuts))
        return pd.DataFrame([cut(b, s, c) if s or c else (b, 0) for b, s, c in zip(body, *pairs)], columns=["text", "n_cut"])

    def flat(pairs, first, second):
        return F.flatten(F.transform(pairs, lambda x: F.array(x[first], x[second])))

    touched = F.col("_spans").isNotNull() | F.col("_cuts").isNotNull()
    # Texts that stay whole do not travel to Python.
    return joined.withColumn("_left", rest(F.when(touched, text_of(text)).otherwise(F.lit("")),
                                              flat("_spans", "first", "last"), flat("_cuts", "first", "end"))).withColumn(
        "_left", F.struct(F.when(touched, F.col("_left.text")).otherwise(F.col(text)).alias("text"), F.col("_left.n_cut").alias("n_cut")))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
          min_words: int = MIN_WORDS) -> DataFrame:
    """All documents with later repeated lines and passages cut out of their text; the columns stay the same."""
    return _left(docs, doc_id, text, min_words).withColumn(text, F.col("_left.text")).select(*docs.columns)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
           min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_lines, n_deleted, n_cut_words, kept_sha256`` per document; words cut are those outside deleted lines."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    joined = _left(picked, "doc_id", "text", min_words)
    lines = F.size(F.split(text_of("text"), "\n", -1))
    gone = F.aggregate(  # spans are sorted, so that each line counts once
        F.coalesce("_spans", F.array().cast("array<struct<first:int,last:int>>")),
        F.struct(F.lit(0).alias("n"), F.lit(-1).alias("at")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["last"] - F.greatest(s["at"], x["first"] - 1), F.lit(0))).alias("n"),
                              F.greatest(s["at"], x["last"]).alias("at")))["n"]
    return joined.select("doc_id", lines.cast("long").alias("n_lines"), gone.cast("long").alias("n_deleted"),
                         F.col("_left.n_cut").alias("n_cut_words"), F.sha2(F.coalesce("_left.text", F.lit("")), 256).alias("kept_sha256"))
