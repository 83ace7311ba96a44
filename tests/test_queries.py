"""Every registered query with an oracle, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from wanetrack.plans import catalog

DATA = "/root/testdata/sf0.001"
book = catalog.book


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(df):
    df = df[sorted(df.columns)].copy()
    for k in df:
        try:
            df[k] = df[k].astype(float).round(6) + 0.0
        except (TypeError, ValueError):
            df[k] = df[k].map(lambda x: None if x is None or x is np.nan else str(x))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(book.ORACLES))
def test_against_duckdb(spark, duck, name):
    got, want = norm(book.QUERIES[name](spark, DATA).toPandas()), norm(duck.sql(book.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for k in got:
        same = (got[k] == want[k]) | (got[k].isna() & want[k].isna())
        assert same.all(), (k, got[~same].head(3), want[~same].head(3))
