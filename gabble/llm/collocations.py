"""Phrase collocations by prefix-free parsing.

The words of each piece of text are parsed into chunks: a chunk starts where the piece starts or at a trigger, a
word whose hash is a multiple of ``TRIGGER``, and runs to the next trigger and ``max_words - 1`` words beyond it, or to the end of
the piece. Where a chunk ends depends on its content alone, so equal passages fall into equal chunks, and no chunk
is a proper prefix of another but at a piece's end. Distinct chunks with their frequencies form the dictionary.

Phrases are counted inside distinct chunks, weighted by frequency. A phrase belongs to the chunk in which it starts before
the next trigger, so what two chunks share is counted once, and every phrase of ``max_words`` words lies whole in one.

Phrases of ``k`` words are counted level by level. A phrase cannot occur more often than its parts, so only those
whose parts all occur ``min_count`` times are worth a row. The tasks know such parts by a bitmap of their hashes, whose
size follows their number up to ``MAX_BITS``; a false hit costs a row and the exact count then drops it.

Edge cases: a null language is ``und``, a null text has no words; repeated rows count each time; ties in the score
go to the higher count, then to the phrase in byte order; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gabble.llm.common import chunks, text_of
from gabble.session import written

MAX_WORDS = 3
MIN_COUNT = 10
#: Rows of the result per language.
TOP = 2000
#: Percent of a phrase's occurrences in one longer phrase from which on it is left out.
INSIDE = 50
SCALE = 1_000_000
#: One word in so many starts a new chunk.
TRIGGER = 16
#: Bits of the bitmap per phrase, and its largest size.
BITS, MAX_BITS = 16, 1 << 30
#: Bytes of text that are parsed, and words that are counted, at a time (a larger text or chunk stands alone).
TEXT_STEP, WORD_STEP = 1 << 22, 1 << 20

#: A-Z are lower-cased, these end a piece, and these separate words.
_ENDS, _GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_PLAIN = bytes(10 if b in _ENDS else 32 if b in _GAPS else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bits of a row that :func:`_bitmap` gathers.
_BUCKET = 1 << 15


def _hashes(distinct: pa.Array) -> np.ndarray:
    values = distinct.cast(pa.binary()).to_pylist()
    return np.fromiter((xxhash.xxh64_intdigest(v, 42) for v in values), np.uint64, len(values))


def _phrase_hashes(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases by those of their first, second, ... words."""
    out = words[0]
    for more in words[1:]:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + more
    return out


def _joined(lists: pa.Array) -> pa.Array:
    return pc.binary_join(lists, " ")


def parse(langs: list[str], texts: list[bytes], max_words: int = MAX_WORDS, trigger: int = TRIGGER) -> pa.Table:
    """``lang, chunk, owned, n``: the chunks of some texts; phrases that start in the first ``owned`` words are theirs."""
    lines = pc.split_pattern(pa.array([t.translate(_PLAIN) for t in texts], pa.binary()).cast(pa.string()), "\n")
    pieces, of_text = lines.flatten(), pc.list_parent_indices(lines)
    split = pc.split_pattern(pieces, " ")
    words, piece = split.flatten(), pc.list_parent_indices(split).to_numpy()
    real = pc.not_equal(words, "")
    words, piece = words.filter(real), piece[real.to_numpy(zero_copy_only=False)]
    n = len(words)
    if not n:
        return pa.table({"lang": pa.array([], pa.string()), "chunk": pa.array([], pa.string()), "owned": pa.array([], pa.int32()),
                         "n": pa.array([], pa.int64())})
    coded = words.dictionary_encode()
    starts = (_hashes(coded.dictionary) % np.uint64(trigger) == 0)[coded.indices.to_numpy()]
    new = np.concatenate([[True], piece[1:] != piece[:-1]])
    start = np.flatnonzero(starts | new)
    piece_end = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new)[start] - 1]
    nxt = np.append(start[1:], n)
    end = np.minimum(nxt + max_words - 1, piece_end)
    end = np.where(nxt == piece_end, piece_end, end)
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, size)
    chunk = _joined(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(at))))
    lang = pa.array(langs, pa.string()).take(of_text.take(pa.array(piece[start])))
    return (pa.table({"lang": lang, "chunk": chunk, "owned": pa.array((nxt - start).astype(np.int32))})
            .group_by(["lang", "chunk", "owned"]).aggregate([([], "count_all")]).rename_columns(["lang", "chunk", "owned", "n"]))


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS) -> DataFrame:
    """``lang, chunk, owned, n``: distinct chunks and how often they occur."""

    def run(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), [t.encode() for t in batch.column(1).to_pylist()]
            for a, b in chunks(map(len, texts), TEXT_STEP):
                yield from parse(langs[a:b], texts[a:b], max_words).to_batches()

    picked = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), text_of(text).alias("text"))
    found = picked.mapInArrow(run, "lang string, chunk string, owned int, n long")
    return found.groupBy("lang", "chunk", "owned").agg(F.sum("n").alias("n"))


def _phrases(batch: pa.Table, size: int, known: list[np.ndarray]) -> pa.Table:
    """``lang, phrase, n`` of some distinct chunks; ``known`` are the bitmaps of the parts of 1, 2, ... words."""
    split = pc.split_pattern(batch.column("chunk").chunk(0), " ")
    words, chunk = split.flatten(), pc.list_parent_indices(split).to_numpy()
    coded = words.dictionary_encode()
    code, n = coded.indices.to_numpy(), len(words)
    of_word = _hashes(coded.dictionary)[code] if known else None
    at = np.arange(n)  # where the parts of k words start that may be frequent
    for k, bits in enumerate(known, 1):
        cell = _phrase_hashes([of_word[at + j] for j in range(k)]) & np.uint64(len(bits) * 8 - 1)
        fine = np.zeros(n + 1, bool)
        fine[at] = bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1 != 0
        # A phrase of one word more needs both parts of k words, in one chunk.
        at = at[fine[at] & fine[at + 1]]
        at = at[at + k < n]
        at = at[chunk[at] == chunk[at + k]]
    first = split.offsets.to_numpy()[:-1]
    at = at[at - first[chunk[at]] < batch.column("owned").to_numpy()[chunk[at]]]
    same = batch.column("lang").chunk(0).dictionary_encode().indices.to_numpy()[chunk[at]].astype(np.int64)
    for j in range(size):  # number the distinct phrases so far, word by word
        same = pa.array(same * len(coded.dictionary) + code[at + j]).dictionary_encode().indices.to_numpy().astype(np.int64)
    n_same = int(same.max()) + 1 if len(same) else 0
    total = np.zeros(n_same, np.int64)
    np.add.at(total, same, batch.column("n").to_numpy()[chunk[at]])
    one = np.zeros(n_same, np.int64)
    one[same[::-1]] = at[::-1]
    phrase = pc.binary_join_element_wise(*[words.take(pa.array(one + j)) for j in range(size)], " ")
    return pa.table({"lang": batch.column("lang").take(pa.array(chunk[one])), "phrase": phrase, "n": pa.array(total)})


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Small batches put together, so that each holds about ``WORD_STEP`` words."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += pc.sum(pc.count_substring(batch.column("chunk"), " ")).as_py() or 0
        n += batch.num_rows
        if n >= WORD_STEP:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _level(chunked: DataFrame, size: int, known: list) -> DataFrame:
    """Exact counts of the phrases of ``size`` words whose parts may all be frequent."""

    def run(batches: Iterator[pa.RecordBatch]):
        maps = [np.frombuffer(k.value, np.uint8) for k in known]
        for table in _gathered(batches):
            yield from _phrases(table, size, maps).combine_chunks().to_batches()

    return (chunked.mapInArrow(run, "lang string, phrase string, n long")
            .groupBy("lang", "phrase").agg(F.sum("n").alias("f")))


def _bitmap(phrases: DataFrame):
    """A broadcast bitmap with the hash of every phrase."""
    bits = min(1 << max(16, (BITS * phrases.count()).bit_length()), MAX_BITS)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                split = pc.split_pattern(batch.column("phrase"), " ")
                coded = split.flatten().dictionary_encode()
                words = _hashes(coded.dictionary)[coded.indices.to_numpy()].reshape(batch.num_rows, -1)
                cell = _phrase_hashes(list(words.T)) & np.uint64(bits - 1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64))], names=["cell"])

    cells = phrases.select("phrase").mapInArrow(run, "cell long")
    rows = cells.groupBy(F.floor(F.col("cell") / _BUCKET).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("cell") % _BUCKET).alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for bucket, part in rows.toLocalIterator():
        out[bucket * _BUCKET // 8:][:_BUCKET // 8] = np.frombuffer(part, np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(out.tobytes())


def counts(chunked: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of all phrases with ``min_count`` occurrences, and ``lang, n``: all words."""
    levels, known, totals = [], [], None
    for size in range(1, max_words + 1):
        found = _level(chunked, size, known)
        if size == 1:
            found = written(found, "words")
            totals = found.groupBy("lang").agg(F.sum("f").alias("n"))
        found = written(found.where(F.col("f") >= min_count), "phrases")
        levels.append(found.withColumn("size", F.lit(size)))
        if size < max_words:
            known.append(_bitmap(found))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, totals


def scored(phrases: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``lang, phrase, size, a, l, r, score``: each phrase of two words or more by its lowest-scoring cut."""
    words = F.split("phrase", " ")
    exact = "decimal(38,0)"
    out = None
    for size in range(2, max_words + 1):
        of = phrases.where(F.col("size") == size).select("lang", "phrase", "size", F.col("f").alias("a"))
        best = None
        for k in range(1, size):
            left = phrases.where(F.col("size") == k).select("lang", F.col("phrase").alias("_l"), F.col("f").alias("l"))
            right = phrases.where(F.col("size") == size - k).select("lang", F.col("phrase").alias("_r"), F.col("f").alias("r"))
            cut = (of.withColumns({"_l": F.array_join(F.slice(words, 1, k), " "), "_r": F.array_join(F.slice(words, k + 1, size - k), " ")})
                   .join(left, ["lang", "_l"]).join(right, ["lang", "_r"]).drop("_l", "_r"))
            square = F.col("a").cast("decimal(16,0)") * F.col("a").cast("decimal(16,0)")
            cut = cut.withColumn("_top", (square * F.lit(SCALE).cast("decimal(7,0)")).cast(exact)).withColumn(
                "_low", (F.col("l").cast("decimal(16,0)") * F.col("r").cast("decimal(16,0)")).cast(exact))
            cut = cut.withColumn("score", F.expr("_top div _low")).withColumn("k", F.lit(k)).drop("_top", "_low")
            best = cut if best is None else best.unionByName(cut)
        lowest = best.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
        lowest = lowest.select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")
        out = lowest if out is None else out.unionByName(lowest)
    return out


def _inside(phrases: DataFrame, max_words: int) -> DataFrame:
    """``lang, phrase, most``: the highest count of a longer phrase around each phrase."""
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, k), " ")))))
    around = phrases.where("size > 2").select("lang", F.col("f"), F.explode(parts).alias("phrase"))
    return around.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
         top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's strongest phrases of two to ``max_words`` words."""
    chunked = written(dictionary(docs, text, lang, max_words), "chunks")
    phrases, totals = counts(chunked, max_words, min_count)
    kept = scored(phrases, max_words).join(_inside(phrases, max_words), ["lang", "phrase"], "left").where(
        f"most is null or 100 * most < {INSIDE} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
