"""Near-duplicates by SimHash fingerprints and pigeonring filtering.

The 64 bits lie on a ring of five segments. If two fingerprints differ in at most four bits, then from some
segment on every chain of ``l`` consecutive segments differs in at most ``l * 4 / 5`` bits: none in the first,
one in the first two, two in three, three in four. So fingerprints meet in a bucket by a segment that is equal,
the chain that starts there prunes pairs step by step, and only survivors get the full Hamming check. With many
fingerprints the bucket holds the first two segments of the chain, one bit of the second left out, which covers
the same pairs in smaller buckets.

Buckets are streams of sorted rows. A bucket over ``BLOCK`` rows is dealt into blocks, and each pair of blocks is
a bucket of its own, so no task holds more than two blocks and no pair is lost. A bucket gives the links of a
spanning forest of its matches, at most one per fingerprint, instead of all pairs. Links become components by
alternating large-star and small-star steps, each written to the shared folder.

Edge cases: a null or empty text has fingerprint zero, linked like any other; equal texts share a fingerprint and
so a component; the component id is the smallest id of its rows, nulls aside (null if there is no other); an
empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gabble.llm.common import text_of
from gabble.session import written

RADIUS = 4
SHINGLE = 4
BLOCK = 2048
#: Distinct fingerprints from which on buckets hold two segments. Both ways find the same pairs.
MANY = 1 << 24
#: Bits of the segments, from the lowest on.
SEGMENTS = (13, 13, 13, 13, 12)

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """SimHash of one text as a signed 64-bit number."""
    parts = text.encode().translate(_LOWER).split()
    if not parts:
        return 0
    line = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= size:
        hashes = [digest(line, 42)]
    else:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths).tolist()
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, ends[size - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, "<u8")
    for at in range(0, len(values), 1 << 16):
        bits = np.unpackbits(values[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: one row per document."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp long")


def _masks() -> list[int]:
    edges = np.cumsum((0, *SEGMENTS)).tolist()
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _buckets(wide: bool) -> list[tuple[int, int]]:
    """(first segment of the chain, mask of the bits that a bucket shares)."""
    masks = _masks()
    if not wide:
        return list(enumerate(masks))
    pairs = []
    for i, mask in enumerate(masks):
        follower = masks[(i + 1) % len(masks)]
        pairs += [(i, mask | (follower & ~(1 << bit))) for bit in range(64) if follower >> bit & 1]
    return pairs


def close_pairs(values: np.ndarray, start: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``radius`` bits whose chain from segment ``start`` keeps its budgets."""
    masks = [np.uint64(m) for m in _masks()]
    count = len(masks)
    lefts, rights = [], []
    for at in range(0, len(values), 512):
        rows = values[at:at + 512]
        differ = rows[:, None] ^ values[None, at:]
        second = np.bitwise_count(differ & (masks[start] | masks[(start + 1) % count])) <= 2 * radius // count
        a, b = np.nonzero(np.triu(second, 1))
        chain, differ = masks[start] | masks[(start + 1) % count], differ[a, b]
        for length in range(3, count + 1):
            chain |= masks[(start + length - 1) % count]
            kept = np.bitwise_count(differ & chain) <= length * radius // count
            a, b, differ = a[kept], b[kept], differ[kept]
        lefts.append(a + at)
        rights.append(b + at)
    return np.concatenate(lefts), np.concatenate(rights)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def links(distinct: DataFrame, wide: bool | None = None, block: int = BLOCK) -> DataFrame:
    """``src, dst``: links between fingerprints of the one-column frame ``distinct``, dst below src."""
    if wide is None:
        wide = distinct.count() > MANY
    buckets = _buckets(wide)
    keys = F.array(*[F.struct(F.lit(i).alias("tag"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part"))
                     for i, (_, m) in enumerate(buckets)])
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.tag", "k.part")
    # Written, so that the join reads both sides from exchanges and Spark can split a large bucket.
    sizes = written(rows.groupBy("tag", "part").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.col("other")
    dealt = (rows.join(sizes, ["tag", "part"]).withColumn("blocks", blocks).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("tag", "part", F.least("own", other).alias("low"), F.greatest("own", other).alias("high"), "fp"))
    order = ["tag", "part", "low", "high"]
    starts = [start for start, _ in buckets]

    def run(batches):
        held = None
        for batch in batches:
            held = _after(held, batch)
            cut = _cut(held)
            yield from _linked(held, 0, cut, starts)
            held = [c[cut:] for c in held]
        if held is not None:
            yield from _linked(held, 0, len(held[0]), starts)

    return (dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "src long, dst long").distinct())


def _after(held, batch):
    new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
    return new if held is None else [np.concatenate(x) for x in zip(held, new)]


def _edges(held) -> np.ndarray:
    """Where a new bucket begins."""
    changed = np.zeros(len(held[0]), bool)
    for c in held[:4]:
        changed[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(changed)


def _cut(held) -> int:
    """Where the last bucket begins; it may go on in the next batch."""
    edges = _edges(held)
    return int(edges[-1]) if len(edges) else 0


def _linked(held, start, end, starts):
    if end <= start:
        return
    held = [c[start:end] for c in held]
    edges = [0, *_edges(held).tolist(), len(held[0])]
    src, dst = [], []
    for a, b in zip(edges, edges[1:]):
        if b - a > 1:
            values = held[4][a:b]
            left, right = close_pairs(values.view(np.uint64), starts[int(held[0][a])])
            if len(left):
                # number the nodes by value, so that a root is the smallest fingerprint
                order = np.argsort(values)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                root = forest(len(values), place[left], place[right])
                child = np.flatnonzero(root != np.arange(len(values)))
                src.append(values[order[child]])
                dst.append(values[order[root[child]]])
    if src:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))],
                                         names=["src", "dst"])


def components(edges: DataFrame) -> DataFrame:
    """``fp, root``: the smallest node that each linked node reaches; roots themselves are left out."""
    edges, state = written(edges.select("src", "dst"), "links"), None
    while True:
        both = edges.union(edges.select("dst", "src"))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        large = large.where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("least"))
        small = (large.join(low, "src")
                 .select(F.explode(F.array(F.struct("src", F.col("least").alias("dst")),
                                           F.struct(F.col("dst").alias("src"), F.col("least").alias("dst")))).alias("e"))
                 .select("e.src", "e.dst").where("src <> dst").distinct())
        edges = written(small, "links")
        total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(total) == state:
            return edges.select(F.col("src").alias("fp"), F.col("dst").alias("root"))
        state = tuple(total)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id``: one row per document."""
    found = written(fingerprints(docs, doc_id, text, size), "simhash")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp")))
    member = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(member.join(ids, "root").select("fp", "component_id"), "named")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: the one with the smallest id; all columns stay.

    Rows that repeat the id of a kept document are copies of one document and stay with it.
    """
    firsts = groups(docs, doc_id, text).select("component_id").distinct()
    first = firsts.withColumnRenamed("component_id", "_first")
    return docs.join(first, docs[doc_id].eqNullSafe(first["_first"]), "left_semi")
