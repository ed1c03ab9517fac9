"""Every registered query against its SQL text, at the smallest scale."""

import os
import sys

import pytest

import __spark_entry__ as entry_module
from corpusloom.oracle import ORACLE
from corpusloom.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = [tuple(row[c] for c in columns) for row in df.collect()]
    result = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [tuple(row[i] for i in order) for row in result.fetchall()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_no_secret_value_in_findings(spark):
    rows = entry_module.queries()["secret_findings"](spark, SF_DIR)
    assert rows.columns == ["repo", "path", "match_ord", "rule"]


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
