"""Every registered query on the smallest tables; results must equal the SQL in DuckDB.

Without a SQL form the query must return rows. QUERY_SF_DIR chooses other tables.
"""

from __future__ import annotations

import os

import pytest
from check import difference, duck

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    got = queries()[name](spark, FOLDER).toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        assert difference(got, con.execute(sql).df()) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
