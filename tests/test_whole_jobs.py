"""Queries that must answer for every row or column, by brute force on the smallest tables."""

import numpy as np
import pytest

from wanetrack.operators import models as X
from wanetrack.plans import evaluation_queries as E
from wanetrack.plans.catalog import book

DATA = "/root/testdata/sf0.001"


def test_analogues_of_every_row(spark):
    p = E.preds(spark, DATA).select("battery_id", "cycle_index", "soh", "y_true").toPandas()
    odd = p.battery_id.astype(int) % 2 == 1
    ref = p[~odd].sort_values(["soh", "y_true"])
    got = {(r.battery_id, r.cycle_index): r for r in book.QUERIES["jon7_nearest_analogues_every_row"](spark, DATA).collect()}
    assert len(got) == odd.sum()
    for r in p[odd].itertuples():
        lo = max(min(int((ref.soh < r.soh).sum()) - 12, len(ref) - 25), 0)
        near = ref.y_true.iloc[lo : lo + 25]
        assert got[r.battery_id, r.cycle_index].n_analogues == len(near)
        assert got[r.battery_id, r.cycle_index].y_pred == pytest.approx(np.median(near), abs=1e-5)


def test_importance_of_every_feature(spark):
    got = book.QUERIES["xpl1_permutation_importance"](spark, DATA).collect()
    assert sorted(r.feature for r in got) == sorted(E.COLS)


def test_analogues_across_blocks_of_places(spark):
    """More reference rows than a block of places, ties among them, and no row put out k times."""
    rng = np.random.default_rng(5)
    soh, rul = rng.integers(0, 3000, 9000) / 3000, rng.integers(0, 90, 9000).astype(float)
    ref = spark.createDataFrame(list(zip(soh.tolist(), rul.tolist(), strict=True)), "soh double, rul double")
    ask = [(i, x) for i, x in enumerate([*np.linspace(-0.1, 1.1, 500).tolist(), 0.0, 1.0])]
    out = X.nearest_analogues(spark.createDataFrame(ask, "k long, soh double"), ref, keys=["k"])
    assert "Generate explode(sequence" not in out._jdf.queryExecution().optimizedPlan().toString()
    near = np.array(sorted(zip(soh, rul, strict=True)))
    got = {r.k: r for r in out.collect()}
    assert len(got) == len(ask)
    for k, x in ask:
        lo = max(min(int((near[:, 0] < x).sum()) - 12, 9000 - 25), 0)
        assert (got[k].y_pred, got[k].n_analogues) == (np.median(near[lo : lo + 25, 1]), 25)
