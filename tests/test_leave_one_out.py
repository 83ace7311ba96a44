"""Leave-one-entity-out results against refits without the entity."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wanetrack.operators import conformal, models


def wanted(scores, level=0.9):
    n = len(scores)
    at = int(np.ceil(round(min(np.ceil(round((n + 1) * level, 9)) / n, 1.0) * (n - 1), 9)))
    return sorted(scores)[at]


def brute_interval(rows, me, stage, prediction):
    others = [r for r in rows if r[0] != me and r[2] is not None and r[3] is not None]

    def quantile(some):
        best = {}
        for e, _, y, p in some:
            best[e] = max(best.get(e, 0.0), abs(p - y))
        return wanted(list(best.values())) if len(best) >= 3 and len(some) >= 20 else None

    q, source = quantile([r for r in others if r[1] == stage]), "stage"
    if q is None:
        q, source = quantile(others), "all"
    if q is None:
        return None, None, "none"
    return (None, None, source) if prediction is None else (max(prediction - q, 0.0), prediction + q, source)


@pytest.mark.parametrize("entities", [1, 3, 4, 6, 15])
def test_intervals_against_refits(spark, entities):
    """Ties, entities without truths, stages that few have reached, rows without a health."""
    rng = np.random.default_rng(entities)
    name = {None: "unknown", 0.95: "early", 0.85: "mid", 0.5: "late"}
    rows = []
    for e in range(entities):
        for _ in range(int(rng.integers(1, 25))):
            soh = [None, 0.95, 0.85, 0.5][rng.integers(0, 4) if e < 5 else rng.integers(2, 4)]
            y = None if e == 2 or rng.random() < 0.1 else float(rng.integers(0, 40))
            rows.append((f"e{e}", soh, y, None if rng.random() < 0.1 else float(rng.integers(0, 40))))
    df = spark.createDataFrame(rows, "battery_id string, soh double, y_true double, y_pred double")
    plain = [(e, name[s], y, p) for e, s, y, p in rows]
    want = sorted((repr((e, name[s], y, p)), *brute_interval(plain, e, name[s], p)) for e, s, y, p in rows)
    got = sorted((repr((r.battery_id, r.stage, r.y_true, r.y_pred)), r.lower, r.upper, r.source) for r in conformal.cross_conformal_intervals(df).collect())
    assert got == want


def test_ridge_without_each_entity_equals_refits(spark):
    """Twenty entities of very different sizes, gaps, a constant column; one entity holds a third of all rows."""
    rng = np.random.default_rng(5)
    out = []
    for e in range(20):
        for k in range(200 if e == 7 else int(rng.integers(5, 30))):
            a, b, c = rng.normal(100, 3), rng.normal(0, 1) * 1e-3, rng.normal(e, 1)
            out.append((f"e{e}", k, None if rng.random() < 0.03 else float(a), float(b), float(c), 2.0, float(3 * a - 2e3 * b + c + rng.normal(0, 1)) if rng.random() < 0.97 else None))
    df = spark.createDataFrame(out, "battery_id string, cycle_index int, a double, b double, c double, d double, y double").repartition(6)
    columns = ["a", "b", "c", "d"]
    got = {r.battery_id: r for r in models.leave_one_out_ridge(df, columns, "y", 0.5).collect()}
    full = [r for r in out if None not in r]
    assert set(got) == {f"e{e}" for e in range(20)}
    for e in got:
        train = np.array([r[2:] for r in full if r[0] != e], float)
        x, y = train[:, :4], train[:, 4]
        n, mx, my = len(x), x.mean(axis=0), y.mean()
        sx, sy = x.std(axis=0), y.std()
        w = np.linalg.lstsq((x - mx).T @ (x - mx) / n + np.diag(0.5 * sx**2 / sy), (x - mx).T @ (y - my) / n, rcond=None)[0]
        w[3] = 0
        assert got[e].coefficients == pytest.approx(w.tolist(), rel=1e-9, abs=1e-9)
        assert got[e].intercept == pytest.approx(my - mx @ w, rel=1e-9)
        assert got[e].n_train == n
    scored = models.leave_one_out(df, columns, "y", 0.5).collect()
    assert len(scored) == sum(r[6] is not None for r in out)
    for r in scored[:50]:
        row = next(o for o in out if (o[0], o[1]) == (r.battery_id, r.cycle_index))
        g = got[r.battery_id]
        want = None if None in row else g.intercept + float(np.dot(g.coefficients, row[2:6]))
        assert r.y_pred == (None if want is None else pytest.approx(want)) and r.y_true == row[6]


def test_ridge_is_the_library_fit(spark):
    """The penalty means what it means in the fitted pipeline."""
    rng = np.random.default_rng(6)
    rows = [(f"e{e}", k, float(a := rng.normal(5, 2)), float(b := rng.normal(0, 9)), float(2 * a - b + rng.normal(0, 1))) for e in range(4) for k in range(30)]
    df = spark.createDataFrame(rows, "battery_id string, cycle_index int, a double, b double, y double")
    got = {r.battery_id: r for r in models.leave_one_out_ridge(df, ["a", "b"], "y", 1.0).collect()}
    for e in got:
        fit = models.pipeline("ridge", ["a", "b"], "y").fit(df.filter(F.col("battery_id") != e)).stages[-1]
        assert got[e].coefficients == pytest.approx(fit.coefficients.toArray().tolist(), rel=1e-6)
        assert got[e].intercept == pytest.approx(fit.intercept, rel=1e-6)


def test_ridge_of_one_entity_and_of_no_rows(spark):
    one = spark.createDataFrame([("x", 1, 1.0, 2.0), ("x", 2, 2.0, 3.0)], "battery_id string, cycle_index int, a double, y double")
    r = models.leave_one_out(one, ["a"], "y").collect()
    assert [x.y_pred for x in r] == [None, None]
    assert models.leave_one_out(one.limit(0), ["a"], "y").collect() == []
