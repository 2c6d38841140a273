"""Secret scan: pattern candidates, and a random forest that removes false positives.

A candidate is a value assigned to a name such as ``token`` or ``dbPassword`` (a quoted one up to its quote), a known
key format, what follows ``bearer``, or any run of 12 or more key characters with a digit. Its features: length; character transitions (mean log probability of its byte pairs under the pairs of
the whole corpus, and entropy); dictionary coverage (share of it that common four-letter pieces of the corpus
cover); path (words of the document's source or path); neighbouring words (names of credentials, of harmless
values, assignment and quotes around it); known key format; a credential's name directly before it. The forest is trained on labelled findings, at most ``max_labels``
of them, chosen by hash; everything else covers all data.

Edge cases: null and empty texts have no candidates; a null path has no words; if the findings hold one class
only, every candidate gets that class (none at all: no candidate is a secret); equal findings of repeated rows
are reported for each row; an empty table gives an empty result. Other columns pass through ``redact``.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gabble.llm.common import by_id, row_key, text_of
from gabble.session import written

MAX_LABELS = 20_000
THRESHOLD = 0.5

_NAMES = r"(?:password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|credential|private[_-]?key|bearer)"
#: A name begins after a sign, or with a capital inside a name such as accessToken.
_BEGIN = r"(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))"
_ASSIGNED = rf"{_BEGIN}{_NAMES}s?[\"']?\s{{0,8}}[=:]{{1,2}}>?\s{{0,8}}"
_KEY = r"A-Za-z0-9+/_\-"
#: Key formats that are known without a name.
_FORMATS = (r"(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_\-]{20,}"
            r"|xox[abeoprs]-[A-Za-z0-9\-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}"
            r"|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"
            r"|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s:,\\\-]{16,}?-----END [A-Z ]{0,30}PRIVATE KEY-----)")
_BEARER = r"(?<![A-Za-z])bearer\s{1,8}"
#: A quoted value goes up to its quote; a bare one to white space, a quote or the next name of a query string.
CANDIDATE = re.compile(
    rf"(?i:{_ASSIGNED})(?:(?P<quote>[\"'])(?P<quoted>(?:(?!(?P=quote))[^\r\n]){{6,}})(?=(?P=quote))"
    rf"|[\"']?(?P<named>(?:[^\s\"',;&<>(){{}}\[\]`]|&(?![A-Za-z_][\w.\-]{{0,64}}=)){{6,}}(?<![.:!?])))"
    rf"|(?<![{_KEY}.])(?P<format>{_FORMATS})"
    rf"|(?i:{_BEARER})(?P<bearer>[{_KEY}.~]{{12,}}={{0,2}})"
    rf"|(?<![{_KEY}])(?P<free>[{_KEY}]*[0-9][{_KEY}]*={{0,2}})")
FORMAT = re.compile(_FORMATS)
#: The text before a value that a credential's name or the word bearer introduces.
NAMED = re.compile(rf"(?i)(?:{_ASSIGNED}[\"']?|{_BEARER})$")
MIN_FREE = 12
NEAR = 48

CREDENTIAL_WORDS = re.compile(rf"(?i){_BEGIN}{_NAMES}s?(?![A-Za-z])")
HARMLESS_WORDS = re.compile(r"(?i)\b(?:sha\d*|md5|commit|revision|uuid|guid|checksum|hash|digest|id|isbn|issn|doi|"
                            r"phone|tel|fax|order|card|invoice|version|date|example|sample|dummy|placeholder|test)\b")
TEST_PATH = re.compile(r"(?i)(?:test|spec|example|sample|fixture|mock|demo|docs?)\b")
CONFIG_PATH = re.compile(r"(?i)(?:conf|config|settings|env|deploy|secrets?|ya?ml|properties|ini)\b")

FEATURES = ("length", "transitions", "entropy", "coverage", "digits", "uppers", "classes_changes", "hex",
            "credential_word", "harmless_word", "assigned", "quoted", "test_path", "config_path", "known_format", "named")

FOUND = "doc_id {kind}, row_key long, start int, end int, value string, before string, after string, path string"


def find(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, value, text before, text after) of each candidate, in code points."""
    found = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span(m.lastgroup)
        if m.lastgroup == "free" and end - start < MIN_FREE:
            continue
        found.append((start, end, text[start:end], text[max(0, start - NEAR):start], text[end:end + NEAR]))
    return found


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()
    place = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    picked = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"),
                         text_of(text).alias("text"), place.alias("path"))

    def run(batches):
        for batch in batches:
            ids, keys, texts, paths = batch.columns
            rows, at = [], []
            for i, (body, where) in enumerate(zip(texts.to_pylist(), paths.to_pylist())):
                for found in find(body):
                    rows.append((*found, where))
                    at.append(i)
            if rows:
                at = pa.array(at, pa.int64())
                start, end, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), keys.take(at), pa.array(start, pa.int32()), pa.array(end, pa.int32()),
                     *[pa.array(c, pa.string()) for c in rest]],
                    names=["doc_id", "row_key", "start", "end", "value", "before", "after", "path"])

    return picked.mapInArrow(run, FOUND.format(kind=kind))


def corpus_tables(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of byte pairs, and counts of hashed four-byte pieces, over all texts.

    Both tables have 65,536 cells whatever the corpus; each task adds its own up first.
    """

    def run(batches):
        pairs, pieces = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                b = np.frombuffer(body.encode(), np.uint8).astype(np.uint32)
                if len(b) > 1:
                    pairs += np.bincount(b[:-1] << 8 | b[1:], minlength=1 << 16)
                    pieces += np.bincount(_pieces(b), minlength=1 << 16)
        for name, cells in ((0, pairs), (1, pieces)):
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), name, np.int32)), pa.array(at.astype(np.int32)),
                                              pa.array(cells[at])], names=["kind", "cell", "n"])

    counted = (docs.select(text_of(text).alias("text")).mapInArrow(run, "kind int, cell int, n long")
               .groupBy("kind", "cell").agg(F.sum("n").alias("n")))
    cells = np.zeros((2, 1 << 16))
    for kind, cell, n in counted.collect():  # at most 2 x 65,536 rows
        cells[kind, cell] = n
    pairs = cells[0].reshape(256, 256) + 0.5
    return np.log(pairs / pairs.sum(1, keepdims=True)).ravel(), cells[1]


def _pieces(b: np.ndarray) -> np.ndarray:
    lower = np.where((b >= 65) & (b <= 90), b + 32, b)
    word = lower[:-3] | lower[1:-2] << 8 | lower[2:-1] << 16 | lower[3:] << 24
    return (word * np.uint32(2654435761)) >> 16


def features(value: str, before: str, after: str, path: str, pairs: np.ndarray, pieces: np.ndarray) -> list[float]:
    b = np.frombuffer(value.encode(), np.uint8).astype(np.uint32)
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    transitions = float(pairs[b[:-1] << 8 | b[1:]].mean()) if len(b) > 1 else 0.0
    common = pieces[_pieces(b)] > pieces.sum() * 2e-5 if len(b) > 3 else np.zeros(0, bool)
    cover = np.zeros(len(b), bool)
    for at in np.flatnonzero(common):
        cover[at:at + 4] = True
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.isalpha() else 3 for c in value]
    changes = sum(x != y for x, y in zip(kinds, kinds[1:])) / len(value)
    near = re.split(r"\s+", before)[-4:]
    near = " ".join(near)
    return [float(len(value)), transitions, entropy, float(cover.mean()), kinds.count(0) / len(value),
            kinds.count(1) / len(value), changes, float(all(c in "0123456789abcdefABCDEF" for c in value)),
            float(bool(CREDENTIAL_WORDS.search(near))), float(bool(HARMLESS_WORDS.search(near))),
            float(bool(re.search(r"[=:]>?\s*[\"']?$", before))),
            float(before[-1:] in "\"'" and before[-1:] != "" and after[:1] == before[-1:]),
            float(bool(TEST_PATH.search(path))), float(bool(CONFIG_PATH.search(path))),
            float(bool(FORMAT.fullmatch(value))), float(bool(NAMED.search(before)))]


def measured(found: DataFrame, tables: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Candidates with their ``features`` array. The tables are of fixed size."""
    shared = found.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf("array<double>")
    def measure(value, before, after, path):
        pairs, pieces = shared.value
        return pd.Series([features(*row, pairs, pieces) for row in zip(value, before, after, path)])

    return found.withColumn("features", measure("value", "before", "after", "path"))


def train(labelled: DataFrame, max_labels: int = MAX_LABELS, seed: int = 7):
    """A forest on ``features, label`` (the constant class if there is only one)."""
    rows = labelled.select("features", F.col("label").cast("double").alias("label"), F.xxhash64("features", "label").alias("h"))
    seen = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return next(iter(seen), 0.0)
    # Secrets are rare: all of them to half the bound (more if there are few others), the rest a sample of the others.
    n = min(seen[1.0], max(max_labels // 2, max_labels - seen[0.0]))
    others = min(seen[0.0], max_labels - n)
    picked = written(rows.where("label = 1").orderBy("h").limit(n)
                     .unionByName(rows.where("label = 0").orderBy("h").limit(others)), "labelled")
    forest = RandomForestClassifier(numTrees=24, maxDepth=6, seed=seed, labelCol="label", featuresCol="vector", weightCol="weight")
    weight = F.when(F.col("label") == 1, F.lit(max(1.0, others / n))).otherwise(F.lit(1.0))
    return forest.fit(picked.withColumn("vector", array_to_vector("features")).withColumn("weight", weight))


def scored(found: DataFrame, model) -> DataFrame:
    """Adds ``score``, the forest's probability of a secret."""
    if isinstance(model, float):
        return found.withColumn("score", F.lit(model))
    out = model.transform(found.withColumn("vector", array_to_vector("features")))
    return out.withColumn("score", vector_to_array("probability")[1]).drop(
        "vector", "rawPrediction", "probability", "prediction")


#: Values that stand for a secret without being one.
_STANDIN = r"(?i)example|sample|dummy|placeholder|change_?me|your[_-]|x{6}|\*{4}|^\$|\{\{|^<|%s"


#: Labelled findings where no reviewed table is given: the reviewers' rule. A known key format is a secret, and so is
#: a value with a letter and a digit or sign that follows a credential's name; stand-ins and all others are not.
def reviewed(found: DataFrame) -> DataFrame:
    facts = dict(zip(FEATURES, range(len(FEATURES))))
    known = F.col("features")[facts["known_format"]] == 1
    named = F.col("features")[facts["named"]] == 1
    keylike = F.col("value").rlike("[A-Za-z]") & F.col("value").rlike(r"[0-9!@#$%^&*+=?~|\\]")
    # A value with a space is a phrase unless it has a digit and a sign.
    phrase = F.col("value").rlike(r"\s") & ~(F.col("value").rlike("[0-9]") & F.col("value").rlike(r"[!@#$%^&*+=?~|\\]"))
    standin = F.col("value").rlike(_STANDIN)
    return found.withColumn("label", (known | (named & keylike & ~phrase & ~standin)).cast("int"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source",
         labels: DataFrame | None = None, max_labels: int = MAX_LABELS) -> DataFrame:
    """One row per candidate: ``doc_id, row_key, start, end, value, score, is_secret``.

    ``labels``: reviewed findings ``value, before, after, path, label``; without it those of :func:`reviewed`.
    """
    tables = corpus_tables(docs, text)
    found = written(measured(candidates(docs, doc_id, text, path), tables), "candidates")
    model = train(reviewed(found) if labels is None else measured(labels, tables), max_labels)
    return (scored(found, model).withColumn("is_secret", F.col("score") >= THRESHOLD)
            .select("doc_id", "row_key", "start", "end", "value", "score", "is_secret"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source",
           mask: str = "[SECRET]", labels: DataFrame | None = None) -> DataFrame:
    """All documents, each secret in their text replaced by ``mask``; the columns stay the same."""
    secrets = (scan(docs, doc_id, text, path, labels).where("is_secret").distinct()
               .groupBy("doc_id", "row_key")
               .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
               .select(F.col("doc_id").alias(doc_id), F.col("row_key").alias("_row_key"), "_spans"))
    joined = by_id(docs.withColumn("_row_key", row_key(doc_id, text)), secrets, [doc_id, "_row_key"])
    body = F.col(text)
    state = F.aggregate(
        "_spans", F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda s, x: F.struct(
            F.concat(s["done"], F.substring(body, s["at"] + 1, x["start"] - s["at"]), F.lit(mask)).alias("done"),
            x["end"].alias("at")))
    masked = F.concat(state["done"], F.substring(body, state["at"] + 1, F.length(body)))
    return joined.withColumn(text, F.when(F.col("_spans").isNull(), body).otherwise(masked)).select(*docs.columns)
