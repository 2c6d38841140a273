"""Scans of landed collector output: CSV and parquet tables, JSON pages, comment trees.

JSON is expected as one document per line, so files split across tasks. ``multi_line`` reads
pretty-printed files, one task per file.
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gabble.functions import text as T
from gabble.sources import schemas, trees

_TEXT_FIELDS = ("author", "comment", "thread_title")
_FILES = 1 << 20


def read_csv(spark: SparkSession, path: str, schema: str, text_fields=()) -> DataFrame:
    """CSV with a header and quoted multi-line text.

    Columns are found by the names in the header, whatever their order; other columns are ignored,
    a missing one is an error. A value that is no number where the schema has one, or a row that is
    no CSV, stops the job. CSV cannot tell an empty from a missing text, so the given text columns
    are filled. Quoted line ends keep one file in one task: land many files, or use parquet.
    """
    wanted = StructType.fromDDL(schema)

    def rows(folder):
        return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
                .option("mode", "FAILFAST").csv(folder))

    # Files may differ in the order of their columns: those with equal headers are read together.
    tables = []
    for header, files in sorted(_headers(spark, path).items()):
        missing = [f.name for f in wanted if f.name not in header]
        if missing:
            raise ValueError(f"{files[0]} lacks the columns {', '.join(missing)}")
        tables.append(rows(files).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in wanted]))
    table = reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], wanted)
    return table.withColumns({c: T.filled(F.col(c)) for c in text_fields})


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files below a path by their header. Reads one line a file."""
    first = (spark.read.text(path)
             .where("_metadata.file_block_start = 0")
             .select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
             .groupBy("file").agg(F.min_by("value", "line").alias("header")))
    headers: dict[tuple[str, ...], list[str]] = {}
    for file, header in first.collect():  # one row a file
        names = tuple(next(csv.reader([header.removeprefix("\ufeff")])))
        headers.setdefault(names, []).append(file)
    return headers


def read_comments(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The fifteen-column comment table."""
    if fmt == "csv":
        return read_csv(spark, path, schemas.COMMENTS, _TEXT_FIELDS)
    return spark.read.schema(schemas.COMMENTS).format(fmt).load(path)


def with_order(scanned: DataFrame, name: str = "ingest_order") -> DataFrame:
    """Number freshly scanned rows in file order: by file name, then by position in the file.

    For parquet the numbers depend on the files alone, not on how they are split or packed into
    tasks; ``name`` rises by one inside a file and leaves a gap to the next. Other formats know no
    position: there the numbers rise with the scan, so store the result before working on.
    """
    try:
        scanned.select("_metadata.row_index")
    except AnalysisException:
        return scanned.withColumn(name, F.monotonically_increasing_id())
    place = scanned.select("*", F.col("_metadata.file_path").alias("_file"),
                           F.col("_metadata.row_index").alias("_row"))
    files = sorted(scanned.inputFiles())
    if len(files) > _FILES:
        raise ValueError(f"{len(files)} files; number at most {_FILES} at a time")
    return place.withColumn("_name", F.element_at(F.split("_file", "/"), -1)).join(
        F.broadcast(_file_numbers(scanned.sparkSession, files)), "_name").withColumn(
        name, F.col("_number") * F.lit(1 << 40) + F.col("_row")).drop("_file", "_row", "_name", "_number")


def _file_numbers(spark: SparkSession, files: list[str]) -> DataFrame:
    """Two numbers a file, at most :data:`_FILES` rows."""
    names = [f.rsplit("/", 1)[-1] for f in files]
    if len(set(names)) < len(names):
        raise ValueError("files of equal names in different folders have no order")
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "_name string, _number bigint")


def read_state(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Earlier results, or an empty table on the first run, when nothing was saved yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_label_sheet(spark: SparkSession, path: str, schema: str = schemas.LABEL_SHEET) -> DataFrame:
    """A label sheet exported as CSV; unfilled slots are empty strings."""
    names = [part.split()[0] for part in schema.split(", ")]
    return read_csv(spark, path, schema, names)


def read_thread_listing(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Search result pages, nested layout: one row per listed thread and search."""
    pages = read_listing_pages(spark, path, multi_line)
    return pages.select("persoon", "query_index", F.explode("data.children.data").alias("t")).select(
        "persoon", "query_index", *thread_columns())


def read_listing_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Search result pages as landed, one row a page."""
    return spark.read.schema(schemas.LISTING_PAGE).option("multiLine", multi_line).json(path)


def thread_columns() -> list[Column]:
    """The columns of a listed thread ``t``."""
    return [
        T.absolute_url(F.col("t.permalink")).alias("url"),
        T.default(F.col("t.title"), "").alias("title"),
        T.default(F.col("t.subreddit"), "").alias("subreddit"),
        T.default(F.col("t.id"), "").alias("thread_id"),
        T.default(F.col("t.score"), 0).alias("score"),
    ]


def read_thread_listing_flat(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Search result pages, flat layout with an author instead of a score."""
    pages = spark.read.schema(schemas.FLAT_LISTING_PAGE).option("multiLine", multi_line).json(path)
    return pages.select(F.explode("data").alias("t")).select(
        T.absolute_url(F.col("t.permalink")).alias("url"),
        T.default(F.col("t.title"), "").alias("title"),
        T.default(F.col("t.subreddit"), "").alias("subreddit"),
        T.default(F.col("t.id"), "").alias("thread_id"),
        T.default(F.col("t.author"), "[deleted]").alias("author"),
    )


def read_comments_flat(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Comment pages, flat layout: live comments with defaults, keyed by the thread they name."""
    pages = spark.read.schema(schemas.FLAT_COMMENT_PAGE).option("multiLine", multi_line).json(path)
    return (
        pages.select(F.explode("data").alias("c"))
        .filter(T.is_live_body(F.col("c.body")))
        .select(
            T.default(F.col("c.author"), "[deleted]").alias("author"),
            F.col("c.body").alias("comment"),
            T.default(F.col("c.score"), 0).alias("score"),
            T.epoch_seconds(F.col("c.created_utc")).alias("timestamp"),
            T.default(F.col("c.id"), "").alias("comment_id"),
            F.regexp_replace("c.link_id", r"\At3_", "").alias("thread_id"),
        )
    )


def read_comment_trees(spark: SparkSession, path: str, whole_files: bool = False,
                       unreadable: str = "fail") -> DataFrame:
    """Thread documents (post listing, comment listing): one row per live comment at any depth."""
    raw = spark.read.text(path, wholetext=whole_files)
    return flatten_trees(raw, "value", unreadable)


def flatten_trees(raw: DataFrame, payload: str, unreadable: str = "fail") -> DataFrame:
    """Live comments of all trees with ``thread_id`` and ``depth``.

    Nodes of another kind than comments are skipped with everything below them. A deleted comment
    is skipped but its replies are kept. A document that is no JSON stops the job; with
    ``unreadable="skip"`` it is left out, and ``trees.unreadable_documents`` lists it.
    """
    node = trees.all_nodes(raw, payload, unreadable)
    return node.filter(T.is_live_body(F.col("body"))).select(
        "thread_id",
        T.absolute_url(F.col("permalink")).alias("url"),
        T.default(F.col("author"), "").alias("author"),
        T.utc_date(F.col("created_utc")).alias("date"),
        T.epoch_seconds(F.col("created_utc")).alias("timestamp"),
        T.default(F.col("score"), 0).alias("score"),
        T.default(F.col("ups"), 0).alias("upvotes"),
        T.default(F.col("downs"), 0).alias("downvotes"),
        T.default(F.col("gilded"), 0).alias("golds"),
        F.col("body").alias("comment"),
        T.default(F.col("id"), "").alias("comment_id"),
        "depth",
    )
