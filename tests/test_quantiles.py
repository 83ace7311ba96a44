"""Exact quantiles by narrowing intervals, against numpy."""

import numpy as np
import pytest

from wanetrack.functions import quantiles as Q

LEVELS = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)


def test_bits_keep_the_order():
    x = np.array([-1e300, -2.5, -2.4999, -5e-324, -0.0, 0.0, 5e-324, 1e-9, 1.0, 1.0000000000000002, 1e300])
    k = Q.ordered_bits(x)
    assert (np.diff(k.astype(object)) >= 0).all() and k[4] == k[5] and len(set(k.tolist())) == 10
    assert (Q.from_bits(k) == x).all()


@pytest.mark.parametrize(("n", "cells", "gather"), [(3000, 1 << 21, 4096), (3000, 1 << 21, 0), (3000, 512, 40), (1, 1 << 21, 4096), (2, 64, 0)])
def test_against_numpy(spark, monkeypatch, n, cells, gather):
    """Wide and narrow spreads, one value for most rows, gaps, infinities, a column without values, few counters."""
    monkeypatch.setattr(Q, "CELLS", cells)
    monkeypatch.setattr(Q, "GATHER", gather)
    rng = np.random.default_rng(n)
    x = np.column_stack([
        rng.normal(0, 1, n), rng.lognormal(0, 20, n) * rng.choice([-1, 1], n), np.where(rng.random(n) < 0.9, 7.25, rng.normal(7, 1, n)), rng.integers(-3, 4, n).astype(float),
        1e9 + rng.random(n) * 1e-3, np.full(n, 2.0), np.full(n, np.nan), rng.normal(0, 1, n),
    ])
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:1, 7] = np.inf
    names = [f"c {i}" for i in range(x.shape[1])]
    rows = [tuple(None if np.isnan(v) and rng.random() < 0.5 else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names)).repartition(4)
    got = {r.feature: r for r in Q.exact_quantiles(df, names, LEVELS).collect()}
    assert list(got) == names
    for i, c in enumerate(names):
        v = x[:, i][np.isfinite(x[:, i])]
        assert got[c].n == len(v)
        assert got[c].quantiles == ([None] * len(LEVELS) if not len(v) else pytest.approx(np.quantile(v, LEVELS).tolist(), rel=1e-12, abs=1e-300))


def test_no_rows_and_other_types(spark):
    df = spark.createDataFrame([(1, 2.5), (3, 3.5), (None, 4.5)], "a int, b float")
    assert [(r.feature, r.n, r.quantiles) for r in Q.exact_quantiles(df, ["a", "b"], (0.5,)).collect()] == [("a", 2, [2.0]), ("b", 3, [3.5])]
    assert [(r.n, r.quantiles) for r in Q.exact_quantiles(df.limit(0), ["a"], (0.5, 0.9)).collect()] == [(0, [None, None])]
