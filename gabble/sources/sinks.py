"""Writers. Parquet is the default; CSV keeps the exchange format with quoted multi-line text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from gabble.functions import text as T
from gabble.sources import schemas


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite a CSV folder: header, UTF-8, white space and line ends of texts kept."""
    (df.write.mode("overwrite")
     .option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_comments(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite the comment table with its fixed column order."""
    ordered = df.select(*schemas.COMMENT_FIELDS)
    if fmt == "csv":
        write_csv(ordered, path)
    else:
        ordered.write.mode("overwrite").format(fmt).save(path)


def write_per_person(df: DataFrame, path: str) -> None:
    """One folder per person below one table for all; no shuffle, so a dominant person is spread
    over all tasks. The files keep the person as an ordinary column; the folder is only for
    finding it."""
    df.withColumn("_person", F.col("persoon")).write.mode("overwrite").partitionBy("_person").parquet(path)


def read_per_person(spark: SparkSession, path: str, schema: str = schemas.COMMENTS, persons: Sequence[str] | None = None
                    ) -> DataFrame:
    """The table of :func:`write_per_person`, or the folders of some persons, every column as written."""
    found = spark.read.schema(f"{schema}, _person string").parquet(path)
    if persons is not None:
        folder = F.col("_person").isin(*persons)
        if "" in persons:  # the empty name has no folder of its own
            folder = folder | F.col("_person").isNull()
        found = found.where(folder & F.col("persoon").isin(*persons))
    return found.drop("_person")


def write_split(tagged: DataFrame, path: str) -> None:
    """Kept and audit rows of a tagged table in one pass, as two partitions of one folder."""
    (tagged.withColumn("side", F.when(F.col("drop_reason") == "", "kept").otherwise("dropped"))
     .write.mode("overwrite").partitionBy("side").parquet(path))


def read_kept(spark: SparkSession, path: str) -> DataFrame:
    """The kept side of :func:`write_split`; only its folder is read."""
    return spark.read.parquet(path).filter("side = 'kept'").drop("side", "drop_reason")


def read_dropped(spark: SparkSession, path: str) -> DataFrame:
    """The audit side of :func:`write_split`; only its folder is read."""
    return spark.read.parquet(path).filter("side = 'dropped'").drop("side")


def printable(df: DataFrame) -> DataFrame:
    """Strip control characters from all string columns."""
    names = [f.name for f in df.schema if isinstance(f.dataType, types.StringType)]
    return df.withColumns({n: T.strip_control(F.col(n)) for n in names})


def export_sample(df: DataFrame, path: str) -> None:
    """A labelled sample for spreadsheet use."""
    write_csv(printable(df), path)


def write_relevant(df: DataFrame, path: str, label: str, value: str = "relevant") -> None:
    """Only the rows judged relevant."""
    df.filter(F.col(label) == value).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> None:
    """A table bucketed by key: tables with equal buckets join and anti-join without a shuffle."""
    first, *rest = keys
    (df.write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, first, *rest).sortBy(first, *rest).saveAsTable(table))
