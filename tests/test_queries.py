"""Every registered query with SQL text gives the same rows as that text on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, cells

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        want = con.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert cells(got) == cells(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
