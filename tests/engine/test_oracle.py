"""Every query with SQL against DuckDB on sf0.001."""

import os

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")
from fathom.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "null" if x != x else f"{x:.6g}"
    if x is None or x is pd.NA or x is pd.NaT:
        return "null"
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


def rows(df):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    mine, theirs = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    assert registry.queries()[name](spark, SF).count() > 0
