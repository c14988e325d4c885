"""Every query with SQL against DuckDB on the smallest tables; the others run and give rows."""

import os

import duckdb
import pandas as pd
import pytest

from quern.plans import analytics, checks, files, genetics, inference, learned, modelling, networks, relational  # noqa: F401
from quern.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    q = QUERIES[name]
    got = q.frame(spark, DATA).toPandas()
    if q.sql is None:
        assert len(got)
        return
    want = duck.sql(q.oracle()).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    floats = [c for c in columns if got[c].dtype.kind == "f" or want[c].dtype.kind == "f"]
    order = [c for c in columns if c not in floats] + floats
    got, want = (x[columns].sort_values(order).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        if c in floats:
            a, b = pd.to_numeric(got[c]).astype(float), pd.to_numeric(want[c]).astype(float)
            assert ((a - b).abs() <= 2e-6).where(a.notna() | b.notna(), True).all(), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
