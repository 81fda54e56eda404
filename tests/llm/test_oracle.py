"""Queries with SQL against DuckDB on sf0.001."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from fathom.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = queries.queries()[name](spark, SF).toPandas(), c.sql(queries.oracle_sql()[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(mine.columns) == columns
    rows = lambda d: sorted(tuple(map(str, r)) for r in d[columns].itertuples(index=False))
    assert rows(mine) == rows(theirs)
