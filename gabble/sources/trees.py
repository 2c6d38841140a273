"""Comment trees of any depth, width and size, flattened level by level with Spark's JSON reader.

A document is a line that the reader takes apart ``LEVELS`` levels deep in one pass; below them, replies stay raw text.
Those raw listings are the frontier: they are written as lines of their own, next to the identity of their thread, and read
again, until none is left. A round so spreads the frontier of a huge thread over tasks, and a chain of many
thousand replies takes one round for each ``LEVELS`` replies. Every round is written, so that a lost executor
repeats one round at most.

The reader gives up a whole array where one of its items has another shape. Such a line is read again child by child,
each on a line of its own, and only the child that does not fit is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from gabble.session import scratch_dir, written

#: Levels that a round takes apart. Threads of people seldom go deeper, and all rounds share one compiled plan.
LEVELS = 16

_TEXTS = ("id", "body", "author", "permalink")
_NUMBERS = ("created_utc", "score", "ups", "downs", "gilded")
_COMMENT = "t1"
_FIELDS = [StructField(n, StringType()) for n in (*_TEXTS, *_NUMBERS)]
_NODE = StructType([*_FIELDS, StructField("depth", IntegerType()), StructField("rest", StringType())])
_OPTIONS = {"columnNameOfCorruptRecord": "odd", "maxNestingDepth": str((1 << 31) - 1), "maxStringLen": str((1 << 31) - 1),
            "allowSingleQuotes": "false"}


def _readable(payload: Column) -> Column:
    """Whether a text is JSON: a member behind it can be read."""
    parsed = F.from_json(F.concat(F.lit('{"d":'), payload, F.lit(',"n":1}')), "n int, odd string", _OPTIONS)
    return parsed["odd"].isNull() & parsed["n"].isNotNull()


def _one_line(payload: Column) -> Column:
    """JSON knows line ends as white space only."""
    return F.regexp_replace(payload, r"[\r\n]", " ")


def unreadable_documents(raw: DataFrame, payload: str) -> DataFrame:
    """``document, error``: the audit side of a run that skips unreadable documents."""
    text = F.col(payload)
    return raw.where(text.isNotNull() & ~_readable(_one_line(text))).select(
        text.alias("document"), F.concat(F.lit("no JSON: "), F.substring(text, 1, 40)).alias("error"))


def _of_children(child: DataType) -> StructType:
    return StructType().add("data", StructType().add("children", ArrayType(child)))


def _listing(levels: int) -> DataType:
    """The type of a listing with so many levels of comments; below them replies are raw."""
    if levels == 0:
        return StringType()
    data = StructType([*_FIELDS, StructField("replies", _listing(levels - 1))])
    return _of_children(StructType().add("kind", StringType()).add("data", data))


def _nodes(read: DataFrame, levels: int) -> DataFrame:
    """The comments of each line's listing, other kinds skipped with everything below them; an odd line stays as it is.

    Every level is one step: a row with a listing becomes its own node and one row for each comment in the listing.
    """
    rows = read.select(_thread(F.col("d")).alias("thread_id"), "depth", "odd", F.lit(None).cast(_NODE).alias("n"),
                       F.when(F.col("odd").isNull(), _comments(F.col("d"))).alias("below"))
    texts = ", ".join(f"'{n}', c.data.{n}" for n in (*_TEXTS, *_NUMBERS))
    for level in range(levels):
        rest, below = ("c.data.replies", "null") if level == levels - 1 else ("cast(null as string)", "c.data.replies")
        rows = rows.selectExpr("thread_id", "depth", "odd", f"""inline(concat(
            array(named_struct('n', n, 'below', null)),
            coalesce(transform(filter(below.data.children, c -> c.kind = '{_COMMENT}'), c -> named_struct(
                'n', named_struct({texts}, 'depth', depth + {level}, 'rest', {rest}), 'below', {below})), array())))""")
        rows = rows.where("n is not null or below is not null or odd is not null")
    return rows.where("n is not null or odd is not null").select("thread_id", "n.*", "odd")


def _line(thread: Column, listing: Column, depth: Column, alone: int) -> Column:
    """A frontier line looks like a document: the post's listing, then the comments'."""
    post = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(thread.alias("id")).alias("data"))).alias("children")).alias("data")))
    return F.concat(F.lit('{"d":['), post, F.lit(","), listing, F.lit('],"depth":'), depth.cast("string"), F.lit(f',"alone":{alone}}}'))


def _read(lines: DataFrame, kind: DataType) -> DataFrame:
    """Write lines and read them again as JSON of the given type."""
    spark = lines.sparkSession
    path = scratch_dir(spark, "frontier")
    lines.write.text(path)
    schema = StructType().add("d", ArrayType(kind)).add("depth", IntegerType()).add("alone", IntegerType()).add("odd", StringType())
    return spark.read.schema(schema).options(**_OPTIONS).json(path)


def _thread(d: Column) -> Column:
    return F.get(F.get(d, F.lit(0))["data"]["children"], F.lit(0))["data"]["id"]


def _comments(d: Column) -> Column:
    return F.get(d, F.lit(1))


def all_nodes(raw: DataFrame, payload: str, unreadable: str = "fail") -> DataFrame:
    """Every comment node of the documents; an unreadable document fails the job or is skipped.

    Skipped documents are listed by :func:`unreadable_documents`. A document that is no pair of listings has no nodes.
    """
    if unreadable not in ("fail", "skip"):
        raise ValueError(f"unreadable must be fail or skip, not {unreadable!r}")
    text = _one_line(F.col(payload))
    ok = _readable(text)
    if unreadable == "fail":
        ok = ok | F.raise_error(F.concat(F.lit("UnreadableDocument: "), F.substring(text, 1, 40))).cast("boolean")
    lines = raw.where(F.col(payload).isNotNull()).where(ok).select(
        F.concat(F.lit('{"d":'), text, F.lit(',"depth":1,"alone":0}')).alias("value"))
    out = None
    while True:
        level = written(_nodes(_read(lines, _listing(LEVELS)), LEVELS), "level")
        left = level.where("rest like '{%' or odd is not null").agg(F.count("rest"), F.count("odd")).first()
        open_lines = level.where("rest like '{%'").select(
            _line(F.col("thread_id"), F.col("rest"), F.col("depth") + 1, 0).alias("value"))
        if left[1]:
            more, lines_of_odd = _odd(level.where("odd is not null").select(F.col("odd").alias("value")))
            level, open_lines = level.unionByName(more), open_lines.union(lines_of_odd)
        level = level.where("odd is null").drop("rest", "odd")
        out = level if out is None else out.unionByName(level)
        if not any(left):
            break
        lines = open_lines
    number = [F.coalesce(F.expr(f"try_cast({n} as bigint)"), F.expr(f"try_cast(try_cast({n} as double) as bigint)")).alias(n)
              for n in _NUMBERS]
    return out.select("thread_id", *_TEXTS, *number, "depth")


def _odd(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with items of another shape: nodes of single children that fit, and further lines."""
    by_child = _read(lines, _of_children(StringType())).where("alone = 0")
    post = F.from_json(F.get(F.get("d", F.lit(0))["data"]["children"], F.lit(0)), "data struct<id:string>", _OPTIONS)
    apart = by_child.select(post["data"]["id"].alias("thread_id"), "depth", F.explode(_comments(F.col("d"))["data"]["children"]).alias("child"))
    listing = F.concat(F.lit('{"data":{"children":['), F.col("child"), F.lit("]}}"))
    single = _line(F.col("thread_id"), listing, F.col("depth"), 1)
    alone = written(_nodes(_read(lines, _listing(1)).where("alone = 1"), 1).where("odd is null"), "level")
    below = alone.where("rest like '{%'").select(_line(F.col("thread_id"), F.col("rest"), F.col("depth") + 1, 0).alias("value"))
    return alone, apart.select(single.alias("value")).union(below)
