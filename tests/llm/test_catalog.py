"""Registered queries of the subpackage against DuckDB on the small tables."""

from pathlib import Path

import duckdb
import pytest

from vectorlens.llm.catalog import QUERIES

FOLDER = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def rows(table):
    table = table.select(sorted(table.column_names))
    return table.column_names, sorted([repr(round(v, 6) if isinstance(v, float) else v) for v in r.values()] for r in table.to_pylist())


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    run, sql = QUERIES[name]
    assert rows(run(spark, str(FOLDER)).toArrow()) == rows(duck.sql(sql).to_arrow_table())


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_runs(spark, name):
    run, _ = QUERIES[name]
    assert run(spark, str(FOLDER)).count() > 0
