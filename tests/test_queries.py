"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows
from tests.helpers import plan

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, engine, name):
    df = entry.queries()[name](spark, FOLDER)
    text = plan(df)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    check = entry.oracle_sql().get(name)
    if check is None:
        assert got
        return
    result = engine.execute(check)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, result.fetchall())


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(NAMES)


def test_entry(spark):
    assert entry.entry(spark).count() == 6
