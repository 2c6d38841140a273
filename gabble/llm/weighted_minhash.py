"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document's terms are its words, weighted by their counts. For each sample ``k`` a term draws, from its hash,
r and c from Gamma(2, 1) and b from U(0, 1). A weight w falls on the step t = floor(ln w / r + b), and the term's
key is ln c - r (t - b + 1). The term with the smallest key is the sample: two documents share it with a
probability equal to their generalised Jaccard similarity, sum of minima over sum of maxima of the weights.
The key depends on term and step only, so its value stands for both, and a document is one hash aggregation with
a minimum per sample.

Edge cases: a null or empty text has no terms; all such documents share one fingerprint, unlike any other;
equal texts share a fingerprint; a null id comes last in descending order; rows that repeat an id follow each
other by text hash and text; the follower of the last document is the first, of a single one itself; an empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gabble.llm.common import text_of
from gabble.session import written

SAMPLES = 32
#: Documents whose ids agree but for so many low bits follow each other inside one task.
PART_BITS = 8
#: Parts whose numbers agree but for so many low bits are chained inside one task.
REGION_BITS = 12

#: Samples that a row draws at a time.
STRIDE = 4

_LAST = -(1 << 63)


def _draws(term: Column, sample: Column) -> tuple[Column, Column, Column]:
    """r, ln c and b of a term under a sample; ``term`` is its 64-bit hash."""
    first, second = F.xxhash64(term, sample), F.xxhash64(term, -1 - sample)
    u = [(F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << 21) - 1)) + 0.5) / float(1 << 21)
         for h, at in ((first, 0), (first, 21), (first, 42), (second, 0), (second, 21))]
    return -F.ln(u[0] * u[1]), F.ln(-F.ln(u[2] * u[3])), u[4]


def signatures(terms: DataFrame, keys: list[str], term: str, weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """Signatures ``s0, s1, …`` (arrays of ints) per ``keys``, one for each column of ``weights`` (0: not a term).

    A row draws ``STRIDE`` samples at a time: the compiled code of all samples in one go would be too long for the
    virtual machine to optimise.
    """
    hashed = terms.select(*keys, F.xxhash64(term).alias("_term"), *[F.ln(w).alias(f"_w{s}") for s, w in enumerate(weights)])
    each = hashed.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(-(-samples // STRIDE) - 1))))
    drawn = each.select("*", *[c.alias(f"_{n}{j}") for j in range(STRIDE) for n, c in zip(
        "rcb", _draws(F.col("_term"), F.col("_turn") * STRIDE + j))])
    key = {f"_k{s}_{j}": F.expr(f"_c{j} - _r{j} * (floor(_w{s} / _r{j} + _b{j}) - _b{j} + 1)")
           for s in range(len(weights)) for j in range(STRIDE)}
    least = (drawn.select(*keys, "_turn", *[c.alias(n) for n, c in key.items()])
             .groupBy(*keys, "_turn").agg(*[F.min(n).alias(n) for n in key]))
    short = least.select(*keys, F.struct("_turn", *[
        F.array(*[F.shiftright(F.xxhash64(f"_k{s}_{j}"), 32).cast("int") for j in range(STRIDE)]).alias(f"s{s}")
        for s in range(len(weights))]).alias("_part"))
    listed = short.groupBy(*keys).agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    return listed.select(*keys, *[F.slice(F.flatten(F.col(f"_parts.s{s}")), 1, samples).alias(f"s{s}")
                                  for s in range(len(weights))])


def likeness(left: str, right: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples."""
    equal = sum((F.get(left, F.lit(i)) == F.get(right, F.lit(i))).cast("int") for i in range(samples))
    return equal / F.lit(float(samples))


def _followers(ids: DataFrame) -> DataFrame:
    """``sid, into``: the first document of each part, and the part whose last document it follows."""
    tops = (ids.groupBy(F.shiftright("sid", PART_BITS).alias("part")).agg(F.max("sid").alias("top"))
            .withColumn("region", F.shiftright("part", REGION_BITS)))
    regions = tops.groupBy("region").agg(F.max("top").alias("region_top"))
    # One row per million ids.
    every = Window.orderBy("region")
    regions = regions.select("region", F.coalesce(
        F.lag("region_top").over(every),
        F.max("region_top").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ).alias("below"))
    inside = Window.partitionBy("region").orderBy("part")
    return tops.join(regions, "region").select(
        F.coalesce(F.lag("top").over(inside), "below").alias("sid"), F.col("part").alias("into"))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``sid, part, place, visits, text, next_text``: documents in descending id order with their follower's text.

    ``sid`` is the id, :data:`_LAST` for null.
    ``part`` and ``place`` number the rows. The first document of a part visits the one above it, so that each
    task has all followers; such rows are marked and only there to be followed.
    """
    sid = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))
    base = docs.select(sid.alias("sid"), text_of(text).alias("text"))
    # Written, so that Spark knows its size when it chooses the join.
    targets = written(_followers(docs.select(sid.alias("sid"))), "followers")
    places = F.array(F.shiftright("sid", PART_BITS), "into")
    placed = (base.join(targets, "sid", "left")
              .select("sid", "text", F.posexplode(places).alias("visit", "part"))
              .where("part is not null")
              .select("sid", "text", "part", (F.col("visit") == 1).alias("visits")))
    order = Window.partitionBy("part").orderBy("visits", F.desc("sid"), F.xxhash64("text"), "text")
    return placed.select("sid", "part", "visits",
                         F.row_number().over(order).alias("place"), "text", F.lead("text").over(order).alias("next_text"))


def edited(text: str, following: str) -> Column:
    """The last third of a text replaced by the beginning of another."""
    cut = F.expr(f"length({text}) div 3").cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), F.length(text) - cut),
                    F.substring(F.col(following), F.lit(1), cut))


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each document and its edited text, and their likeness to it and to the next document."""
    rows = with_next(docs, doc_id, text).withColumn("next_text", F.coalesce("next_text", F.lit("")))
    id_of = F.nullif("sid", F.lit(_LAST)).cast(docs.schema[doc_id].dataType).alias("doc_id")
    facts = rows.select("part", "place", "sid", "visits", F.length("text").cast("long").alias("n_chars"),
                        F.sha2(edited("text", "next_text"), 256).alias("edited_sha256"))
    terms = (rows.select("part", "place", F.posexplode(F.array("text", edited("text", "next_text"))).alias("side", "body"))
             .select("part", "place", "side", F.explode(F.split("body", r"[\x20\x09-\x0D]+")).alias("term")).where("term <> ''")
             .groupBy("part", "place", "term").agg(F.sum(1 - F.col("side")).alias("own"), F.sum("side").alias("changed")))
    signed = signatures(terms, ["part", "place"], "term", ["own", "changed"], samples)
    none = F.array(*[F.shiftright(F.xxhash64(F.lit(None).cast("double")), 32).cast("int")] * samples)
    whole = facts.join(signed, ["part", "place"], "left").select(
        "part", "place", "sid", "visits", "n_chars", "edited_sha256", F.coalesce("s0", none).alias("fingerprint"),
        F.coalesce("s1", none).alias("edited_fingerprint"))
    following = Window.partitionBy("part").orderBy("place")
    return (whole.withColumn("next", F.lead("fingerprint").over(following)).where("not visits")
            .select(id_of, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                    likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"),
                    likeness("fingerprint", "next", samples).alias("near_next")))
