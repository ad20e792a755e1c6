"""Every registered query against DuckDB on the small tables; queries without SQL must run and return rows."""

import math
from pathlib import Path

import duckdb
import pytest

from vectorlens.catalog import all_queries

FOLDER = Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES = all_queries()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def rows(table):
    table = table.select(sorted(table.column_names))
    return table.column_names, sorted([plain(v) for v in row.values()] for row in table.to_pylist())


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, duck, name):
    run, sql = QUERIES[name]
    assert rows(run(spark, str(FOLDER)).toArrow()) == rows(duck.sql(sql).to_arrow_table())


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_runs(spark, name):
    run, _ = QUERIES[name]
    assert run(spark, str(FOLDER)).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) < set(contract.queries())
    frame = contract.entry(spark)
    assert frame.columns == ["vec_id", "x", "y", "cluster"] and frame.count() > 0
