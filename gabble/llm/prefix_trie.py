"""Prefix trie of conversations by van Emde Boas recursion.

Every sequence of turns is cut at half its (padded) depth, the halves at half theirs, and so on down to blocks of
``HEIGHT`` turns. Going up, the halves of a segment are named by the digest of what they hold; going down, the name of
the cut prefix becomes the root of the lower half, so that the upper trie and all lower forests of one size are
built in the same round. A trie of depth ``D`` takes ``log2(D / HEIGHT)`` rounds each way, whatever its shape.

Totals are grafted upward the same way: a block adds its nodes to their ancestors inside it, and the nodes at block
borders then take over the totals hanging ``1, 2, 4, ...`` blocks below them, again ``log2(D / HEIGHT)`` rounds.

Nothing gathers a conversation, a node's members or its children: blocks hold at most ``HEIGHT`` turns, counts are
summed inside the tasks first, turns are numbered by ranges that cut a long conversation into several, and the
members that end in a node are joined to pieces of ``PIECE`` ids before one stream takes their digest.

Edge cases: null roles and texts are empty; null turns come first; rows of one turn are ordered by role, then by the
digest of role and text, and equal rows all count; rows without ``conv_id`` belong to no conversation; an empty table
gives no node at all; other columns are not read. Names are 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gabble.session import written

#: Turns of a block, the smallest piece of the recursion.
HEIGHT = 8
#: Ids that are joined before a digest reads them.
PIECE = 4096
#: Branches of one conversation: ids from a multiple of this on.
FAMILY = 100
#: A branch takes over fewer turns than this.
HEADS = 6


def _name(*parts: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def _root() -> Column:
    return _name(F.lit("").cast("binary"))


def numbered(turns: DataFrame, key: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``turns`` laid out in ranges of (key, order) with ``part`` and ``row``; per key and part the ``first`` row, how
    many rows, and how many ``before`` it. The number of a row in its key is ``row - first + before``."""
    laid = written(turns.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
                   .withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "turns")
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (laid.groupBy(key, "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
            .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    return laid, runs


def branched(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as branches of their family's first one.

    Returns ``conv_id`` of all, and ``conv_id, depth, token, chars``: the first ``crc32(conv_id) % HEADS`` turns of
    conversation ``conv_id - conv_id % FAMILY``, then the own turns after as many; depths from 1 on.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    token = _name(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "utf-8"))
    picked = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), token.alias("token"),
        F.length(text).cast("long").alias("chars"))
    laid, runs = numbered(picked, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("token")])
    runs = written(runs, "runs")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = runs.groupBy("conv_id").agg(F.sum("n").alias("n_own")).withColumns(
        {"family": F.col("conv_id") - F.col("conv_id") % FAMILY, "head": head})
    sizes = convs.select(F.col("conv_id").alias("family"), F.col("n_own").alias("n_family"))
    convs = written(convs.join(sizes, "family", "left").select(
        "conv_id", "family", "head", F.least("head", F.coalesce("n_family", F.lit(0))).alias("taken")), "convs")
    places = runs.join(convs, "conv_id").drop("n")
    at = laid.join(places, ["conv_id", "part"]).withColumn("pos", F.col("row") - F.col("first") + F.col("before"))
    own = at.where("pos >= head").select(
        "conv_id", (F.col("pos") - F.col("head") + F.col("taken") + 1).alias("depth"), "token", "chars")
    first = at.where(f"pos < {HEADS - 1} and conv_id % {FAMILY} = 0").select(
        F.col("conv_id").alias("family"), "pos", "token", "chars")
    taken = convs.join(first, "family").where("pos < head").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "token", "chars")
    return convs.select("conv_id"), own.unionByName(taken)


def blocks(sequences: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``conv_id, block, tokens, chars, length, root, next``: the blocks of all sequences, the cut prefix above each, and
    the cut prefix that a full block ends in. ``length`` is that of the whole sequence."""
    turn = F.struct("depth", "token", "chars")
    cut = (sequences.groupBy("conv_id", F.floor((F.col("depth") - 1) / height).alias("block"))
           .agg(F.array_sort(F.collect_list(turn)).alias("t"))
           .select("conv_id", "block", F.col("t.token").alias("tokens"), F.col("t.chars").alias("chars")))
    cut = written(cut, "blocks")
    sizes = cut.groupBy("conv_id").agg(F.sum(F.size("tokens")).alias("length"))
    most = (sizes.agg(F.max("length")).first()[0] or 0) // height + 1
    short = cut.join(sizes.where(F.col("length") < height), "conv_id").withColumns(
        {"root": _root(), "next": F.lit(None).cast("binary")})
    if most == 1:
        return short
    # Only sequences with a full block take part in the rounds.
    long = written(cut.join(sizes.where(F.col("length") >= height), "conv_id"), "long")
    whole = F.aggregate("tokens", F.lit("").cast("binary"), lambda a, t: F.concat(a, t))
    names = [written(long.where(F.size("tokens") == height)
                     .select("conv_id", F.col("block").alias("b"), _name(whole).alias("name")), "names")]
    levels = (most - 1).bit_length()
    for _ in range(levels - 1):
        halves = names[-1].groupBy("conv_id", F.shiftright("b", 1).alias("b")).agg(
            F.max(F.when(F.col("b") % 2 == 0, F.col("name"))).alias("upper"),
            F.max(F.when(F.col("b") % 2 == 1, F.col("name"))).alias("lower"))
        names.append(written(halves.where("upper is not null and lower is not null")
                             .select("conv_id", "b", _name("upper", "lower").alias("name")), "names"))
    roots = long.where("block = 0").select("conv_id", F.floor(F.col("length") / height).alias("most"),
                                           F.lit(0).cast("long").alias("b"), _root().alias("root"))
    for level in reversed(range(levels)):
        # The upper half keeps the root; what the upper half holds names the root of the lower half.
        upper = names[level].where("b % 2 = 0").select("conv_id", F.shiftright("b", 1).alias("b"), "name")
        both = roots.join(upper, ["conv_id", "b"], "left")
        below = F.shiftleft(F.col("b") * 2 + 1, level) <= F.col("most")
        halves = F.array(F.struct((F.col("b") * 2).alias("b"), F.col("root").alias("root")),
                         F.when(below, F.struct((F.col("b") * 2 + 1).alias("b"), _name("root", "name").alias("root"))))
        roots = written(both.select("conv_id", "most", F.explode(halves).alias("h")).where("h is not null")
                        .select("conv_id", "most", "h.b", "h.root"), "roots")
    after = roots.select("conv_id", (F.col("b") - 1).alias("block"), F.col("root").alias("next"))
    rooted = long.join(roots.select("conv_id", F.col("b").alias("block"), "root"), ["conv_id", "block"])
    return rooted.join(after, ["conv_id", "block"], "left").unionByName(short)


def _steps(rooted: DataFrame, height: int) -> DataFrame:
    """A row per turn of each sequence: its node, the nodes above it in its block, and whether the sequence ends there."""
    path = F.aggregate("tokens", F.array("root"),
                       lambda a, t: F.concat(a, F.array(_name(F.element_at(a, -1), t))))
    # A node at a border goes by the name of the cut, under which the block below it hangs.
    path = F.when(F.col("next").isNotNull(), F.concat(F.slice(path, 1, height), F.array("next"))).otherwise(path)
    steps = rooted.withColumn("path", path).select(
        "conv_id", "block", "length", "path", F.posexplode("chars").alias("at", "chars"))
    depth = F.col("block") * height + F.col("at") + 1
    return steps.select("conv_id", F.slice("path", F.lit(1), F.col("at") + 2).alias("path"), depth.alias("depth"), "chars",
                        (depth == F.col("length")).alias("ends"))


def _ends(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256``: the digest of the ids that end in each node, in order."""

    def joined(batches):
        node, ids = None, []
        for batch in batches:
            out = [[], [], []]
            for of, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if of != node or len(ids) == PIECE:
                    if ids:
                        _put(out, node, ids)
                    node, ids = of, []
                ids.append(conv)
            yield _pieces(out)
        if ids:
            _put(out := [[], [], []], node, ids)
            yield _pieces(out)

    def digests(batches):
        node, digest = None, None
        for batch in batches:
            done = [], []
            for of, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if of != node:
                    if digest:
                        done[0].append(node), done[1].append(digest.hexdigest())
                    node, digest = of, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], names=["node", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    pieces = (ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
              .mapInArrow(joined, "node binary, first long, ids string"))
    return (pieces.repartition("node").sortWithinPartitions("node", "first")
            .mapInArrow(digests, "node binary, ends_sha256 string"))


def _put(out: list[list], node: bytes, ids: list[int]) -> None:
    for column, value in zip(out, (node, ids[0], ",".join(map(str, ids)))):
        column.append(value)


def _pieces(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                                      names=["node", "first", "ids"])


def trie(convs: DataFrame, sequences: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The nodes of the trie of ``sequences`` (``conv_id, depth, token, chars``); ``convs`` holds all ``conv_id``, each once."""
    steps = written(_steps(blocks(sequences, height), height), "steps")
    members = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = members.select(F.array(_root()).alias("path"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"),
                         "conv_id", "n_convs")
    nodes = steps.groupBy("path", "depth", "chars").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    nodes = written(nodes.unionByName(top).withColumns(
        {"node": F.element_at("path", -1), "parent": F.when(F.size("path") > 1, F.element_at("path", -2))}), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumns({
        "leaf": (F.col("n_children") == 0).cast("long"), "saving": (F.col("n_convs") - 1) * F.col("chars")}), "children")

    # Each node adds itself to those above it in its block; a node at a border so gets itself and the block below.
    summed = [F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved")]
    own = written(nodes.select(F.explode("path").alias("node"), "leaf", "saving").groupBy("node").agg(*summed), "inside")
    border = (F.size("path") == height + 1) | (F.col("depth") == 0)
    edges = nodes.where(border).join(own, "node").select(
        "node", "path", F.when(F.col("depth") > 0, F.element_at("path", 1)).alias("up"),
        (F.col("leaves") - F.col("leaf")).alias("leaves"), (F.col("saved") - F.col("saving")).alias("saved"))
    total = own
    if nodes.where(F.size("path") == height + 1).limit(1).count():
        edges = written(edges, "edges")
        while edges.where("up is not null").limit(1).count():
            # What hangs 1, 2, 4, ... blocks below is grafted on.
            below = edges.where("up is not null").groupBy(F.col("up").alias("node")).agg(
                F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
            above = edges.select(F.col("node").alias("up"), F.col("up").alias("next"))
            edges = written(edges.join(below, "node", "left").join(above, "up", "left").select(
                "node", "path", F.col("next").alias("up"),
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "edges")
        # What hangs below a border also hangs below the nodes above it in its block.
        inside = edges.where(F.size("path") == height + 1).select(
            F.explode(F.slice("path", 2, height - 1)).alias("node"), "leaves", "saved")
        at = nodes.where(border).select("node", F.col("leaf").alias("leaves"), F.col("saving").alias("saved"))
        plain = own.join(nodes.where(border).select("node"), "node", "left_anti")
        total = (plain.unionByName(inside).unionByName(at).unionByName(edges.select("node", "leaves", "saved"))
                 .groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    ended = steps.where("ends").select(F.element_at("path", -1).alias("node"), "conv_id")
    turnless = convs.join(steps.select("conv_id").distinct(), "conv_id", "left_anti").select(_root().alias("node"), "conv_id")
    ends = _ends(ended.unionByName(turnless))
    named = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(total, "node").join(ends, "node", "left").join(named, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def report(turns: DataFrame) -> DataFrame:
    """The trie of all conversations (``conv_id, turn, role, text``), rebuilt as branches."""
    return trie(*branched(turns))
