"""Token counts as rollups maintained by signed changes.

Changes are rows of source, language, tokenizer version, sign and count: an insert is +1, a delete -1, a revised
count both. A batch of them is summed up (in the tasks first, so a source with a third of all rows is a few numbers
per task) and committed under its own name as a small table; totals are the sums over all committed batches. A
commit is idempotent: a batch that was completed before is left as it is, one that broke off is written anew.

Edge cases: a null text counts as empty; null source, language or version is a group of its own; rows that repeat an
id count each; deleting what was never inserted gives negative totals, as late batches may arrive in any order;
groups without documents and tokens are left out of the totals; no committed batch gives empty totals; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gabble.llm.common import text_of
from gabble.session import written

KEYS = ["source", "lang", "tokenizer_version"]
CHANGE = "source string, lang string, tokenizer_version string, sign int, n_tokens long"
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


@lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, rank_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
            source: str = "source", lang: str = "lang") -> DataFrame:
    """``doc_id, source, lang, digest, n_bytes, n_tokens``: one row per document, whole texts."""
    kind = docs.schema[doc_id].dataType.simpleString()
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                         F.col(lang).cast("string").alias("lang"), F.sha2(text_of(text), 256).alias("digest"),
                         F.octet_length(text_of(text)).cast("long").alias("n_bytes"), text_of(text).alias("text"))

    def run(batches):
        tokens = encoding(rank_file, pattern)
        for batch in batches:
            n = [len(tokens.encode_ordinary(t)) for t in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n, pa.int64())],
                                             names=[*batch.schema.names[:5], "n_tokens"])

    return picked.mapInArrow(run, f"doc_id {kind}, source string, lang string, digest string, n_bytes long, n_tokens long")


def changes(rows: DataFrame, sign: int, version: str, n_tokens: Column) -> DataFrame:
    """Signed changes, one per row of ``rows`` (``source, lang`` and what ``n_tokens`` needs)."""
    return rows.select("source", "lang", F.lit(version).alias("tokenizer_version"),
                       F.lit(sign).alias("sign"), n_tokens.cast("long").alias("n_tokens"))


class Rollup:
    """Committed batches below a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _status(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files, place

    def _committed(self, path: str) -> bool:
        files, place = self._status(f"{path}/_SUCCESS")
        return files.exists(place)

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        files, place = self._status(self.folder)
        if not files.exists(place):
            return []
        names = [f.getPath().getName() for f in files.listStatus(place) if f.isDirectory()]
        return sorted(n.removeprefix("batch=") for n in names if self._committed(f"{self.folder}/{n}"))

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Commit signed changes under a name; False if that batch was committed before."""
        path = f"{self.folder}/batch={batch}"
        if self._committed(path):
            return False
        delta = rows.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"),
                                        F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        delta.coalesce(1).write.mode("overwrite").parquet(path)  # one row per group; no marker yet, so a rest of a broken run goes
        return True

    def totals(self) -> DataFrame:
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], TOTALS)
        found = self.spark.read.schema(TOTALS).parquet(*[f"{self.folder}/batch={n}" for n in names])
        return (found.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .where("n_docs <> 0 or n_tokens <> 0"))


def later_copies(rows: DataFrame) -> DataFrame:
    """Rows whose text a row with a smaller id has as well."""
    firsts = (rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
              .where("first < last").select("digest", "first"))
    # Written, so that the join reads both sides from exchanges and Spark can split a frequent text.
    firsts = written(firsts, "firsts")
    return rows.join(firsts, "digest").where("doc_id > first").drop("first")


def maintained(docs: DataFrame, folder: str, rank_file: str, pattern: str, version: str) -> DataFrame:
    """A table's life in three batches: loaded with estimates, recounted by the tokenizer, rid of exact copies.

    Every batch is sent twice, as a restarted job would; the totals count it once.
    """
    spark = docs.sparkSession
    rows = written(counted(docs, rank_file, pattern), "counted")
    estimate, rollup = F.ceil(F.col("n_bytes") / 4), Rollup(spark, folder)
    steps = {
        "load": changes(rows, 1, "bytes/4", estimate),
        "recount": changes(rows, -1, "bytes/4", estimate).unionByName(changes(rows, 1, version, F.col("n_tokens"))),
        "copies": changes(later_copies(rows), -1, version, F.col("n_tokens")),
    }
    for _ in range(2):
        for name, step in steps.items():
            rollup.commit(name, step)
    return rollup.totals()
