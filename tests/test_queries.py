"""Every registered query of the library against DuckDB on the same tables."""

import decimal
import numbers
import os

import duckdb
import pandas as pd
import pytest
from bibspark.plans import REGISTRIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {k: f for r in REGISTRIES for k, f in r.QUERIES.items()}
SQL = {k: q for r in REGISTRIES for k, q in r.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, (numbers.Real, decimal.Decimal)) and not isinstance(v, bool):
        return repr(float(v))
    return str(v)


def rows(df):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
