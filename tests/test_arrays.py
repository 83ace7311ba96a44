"""Sums over many columns at once, against numpy."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wanetrack.functions import arrays
from wanetrack.operators import preprocess


def table(rng, n, d, gaps):
    x = rng.normal(0, 1, (n, d)) * rng.choice([1e-3, 1, 1e6], d) + rng.choice([0, 5, 1e7], d)
    x[:, 1] = 3 * x[:, 0] + rng.normal(0, 0.01, n) * np.abs(x[:, 0])
    if d > 5:
        x[:, 4] = 7.3
    x[rng.random((n, d)) < gaps] = np.nan
    return pd.DataFrame(x, columns=[f"c.{i}" if i == 3 else f"c{i}" for i in range(d)])


@pytest.mark.parametrize(("n", "d", "gaps", "block"), [(400, 12, 0.2, 1024), (400, 12, 0.2, 5), (60, 7, 0.0, 1024), (30, 6, 0.9, 2), (1, 3, 0.0, 9)])
def test_correlations_against_pandas(spark, monkeypatch, n, d, gaps, block):
    monkeypatch.setattr(arrays, "BLOCK", block)
    monkeypatch.setattr(arrays, "FAN_IN", 2)
    p = table(np.random.default_rng(n + d), n, d, gaps)
    df = spark.createDataFrame(p).repartition(5)
    df = df.select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) for c in df.columns])
    got = preprocess.correlations(df, list(p.columns)).collect()
    assert sorted((r.a, r.b) for r in got) == sorted((a, b) for i, a in enumerate(p.columns) for b in p.columns[i + 1 :])
    for r in got:
        both = p[[r.a, r.b]].dropna()
        if len(both) < 2 or both[r.a].nunique() < 2 or both[r.b].nunique() < 2:
            assert r.rho is None
        else:
            centred = both - both.mean()  # pandas' own corr() loses digits where a large constant is added
            assert r.rho == pytest.approx(np.corrcoef(centred[r.a], centred[r.b])[0, 1], abs=1e-8)


def test_infinite_values_count_as_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (float("inf"), 1.0), (3.0, float("nan")), (4.0, 8.0)], "a double, b double")
    assert preprocess.correlations(df, ["a", "b"]).first().rho == pytest.approx(1.0)


def test_no_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert preprocess.correlations(df, ["a", "b"]).collect() == []


def test_seven_hundred_columns(spark, tmp_path):
    """One pass, and the earlier of two columns that go together is dropped."""
    x = np.random.default_rng(7).normal(0, 1, (300, 700))
    x[:, 699] = 2 * x[:, 3] + 1
    pq.write_table(pa.table({f"f{i}": x[:, i] for i in range(700)}), tmp_path / "wide.parquet")
    df = spark.read.parquet(str(tmp_path / "wide.parquet"))
    got = preprocess.correlations(df, df.columns)
    assert got.count() == 700 * 699 // 2
    dropped = preprocess.correlation_prune(df, df.columns).filter("dropped").collect()
    assert [r.feature for r in dropped] == ["f3"]
