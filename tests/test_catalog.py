"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from catalog.oracles import ORACLES
from catalog.queries import QUERIES
from check import TABLES, canonical

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES.split():
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = canonical(entry_module.queries()[name](spark, SF).toPandas())
    assert got == canonical(duck.execute(entry_module.oracle_sql()[name]).df())


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and sorted(r.seq for r in rows) == list(range(1, len(rows) + 1))
