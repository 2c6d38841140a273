"""Every operator on nulls, empty and long texts, repeated rows, clashing names, and an empty table."""

import public_tokenizers
import pytest

import corpus_pipeline
from gabble.llm import (
    bpe, packing, quality, repetition, secrets, simhash, token_rollup, toxicity, weighted_minhash, winnow,
)
from tests.llm import data


def labels(docs):
    return docs.sparkSession.createDataFrame([(0, 1), (4, 0), (5, 0), (9, None), (None, 1), (8, 0), (10, 1)],
                                             "doc_id long, toxic int")


#: Operators with a row per document.
BY_DOCUMENT = {
    "bpe": lambda d: bpe.digests(d, data.RANKS, public_tokenizers.PATTERN),
    "ids": lambda d: bpe.encode(d, data.RANKS, public_tokenizers.PATTERN),
    "quality": quality.score,
    "simhash": simhash.groups,
    "repetition": repetition.score,
    "toxicity": lambda d: toxicity.score(d, labels(d)),
    "winnow": winnow.report,
    "winnow_clean": winnow.clean,
    "redact": secrets.redact,
    "weighted": weighted_minhash.compare,
    "counted": lambda d: token_rollup.counted(d, data.RANKS, public_tokenizers.PATTERN),
}
OTHERS = {
    "scan": secrets.scan,
    "pack": packing.pack,
    "quality_keep": quality.keep,
    "repetition_keep": repetition.keep,
    "keep_first": simhash.keep_first,
}


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_edge_rows(spark, name):
    rows = BY_DOCUMENT[name](data.edge(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in data.TEXTS)


@pytest.mark.parametrize("name", OTHERS)
def test_edge_rows_of_others(spark, name):
    assert OTHERS[name](data.edge(spark)).count() > 0


@pytest.mark.parametrize("name", [*BY_DOCUMENT, *OTHERS])
def test_empty_table(spark, name):
    assert {**BY_DOCUMENT, **OTHERS}[name](data.empty(spark)).collect() == []


def test_pipeline_on_edge_rows(spark):
    docs = data.edge(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows, docs.schema)
    assert {r["doc_id"] for r in rows} >= {0, 5, 11}
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_dedup", "secret_scan", "packing"]


def test_pipeline_on_an_empty_table(spark):
    docs = data.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.collect() == []
