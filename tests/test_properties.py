"""Operators that SQL cannot express: fitted models, seeded draws and p-values, by properties and closed forms."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wanetrack.operators import calibrate, drift, isotonic, metrics, models, monitoring, preprocess, splits


@pytest.fixture(scope="module")
def rows(spark):
    """y = 3 a - 2 b + noise over twelve entities; c is noise; risk follows a."""
    rng = np.random.default_rng(2)
    out = []
    for e in range(12):
        for k in range(25):
            a, b, c = rng.normal(0, 1, 3)
            out.append((f"e{e}", k, float(a), float(b), float(c), float(3 * a - 2 * b + rng.normal(0, 0.1)), int(rng.random() < (0.9 if a > 1 else 0.05))))
    return spark.createDataFrame(out, "battery_id string, cycle_index int, a double, b double, c double, y double, label int").cache()


def test_folds_split_entities_evenly_and_repeatably(rows):
    got = splits.grouped_folds(rows, 5).collect()
    assert sorted(r.battery_id for r in got) == sorted({f"e{i}" for i in range(12)})
    sizes = [sum(r.fold == f for r in got) for f in range(5)]
    assert max(sizes) - min(sizes) <= 1
    assert {tuple(r) for r in got} == {tuple(r) for r in splits.grouped_folds(rows.repartition(7), 5).collect()}
    assert {tuple(r) for r in got} != {tuple(r) for r in splits.grouped_folds(rows, 5, seed=43).collect()}


def test_leave_one_out_has_a_bound(rows):
    with pytest.raises(ValueError, match="more than 5 entities"):
        splits.leave_one_out(rows, most=5)


def test_bootstrap_covers_the_error(spark):
    rng = np.random.default_rng(3)
    e = rng.exponential(2, 400)
    df = spark.createDataFrame([(0.0, float(v)) for v in e], "y_true double, y_pred double")
    r = metrics.bootstrap_mae(df, 200)
    got = r.first()
    half = 1.645 * e.std() / math.sqrt(len(e))
    assert got.mean == pytest.approx(e.mean(), abs=half)
    assert got.low == pytest.approx(e.mean() - half, abs=half / 2) and got.high == pytest.approx(e.mean() + half, abs=half / 2)
    assert tuple(metrics.bootstrap_mae(df, 200).first()) == tuple(got)


def test_bootstrap_weights(spark):
    """Poisson(1) numbers that depend on the row alone; no row is written once a replicate."""
    w = metrics.poisson_weights(np.arange(20_000, dtype=np.int64) * 977 - 5_000_000, 50)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w[:, :8].T)[np.triu_indices(8, 1)]).max() < 0.04 and abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.04
    df = spark.createDataFrame([(0.0, float(i)) for i in range(300)], "y_true double, y_pred double")
    got = tuple(metrics.bootstrap_mae(df.repartition(7)).first())
    assert got == pytest.approx(tuple(metrics.bootstrap_mae(df).first()), rel=1e-12)
    assert tuple(metrics.bootstrap_mae(df, seed=8).first()) != got
    assert tuple(metrics.bootstrap_mae(df.limit(0)).first()) == (None, None, None)


@pytest.mark.parametrize(("rows", "said"), [
    ([("a", "train"), ("a", "test"), ("b", "test")], "a is in the splits test, train"), ([("a", "train"), ("b", "val")], "the split test is empty"),
    ([("a", "test")], "the split train is empty"), ([("a", "train"), ("b", "test"), ("c", "other")], "unknown splits: other"), ([], "the split train is empty"),
])
def test_bad_splits_are_refused(spark, rows, said):
    with pytest.raises(ValueError, match=said):
        splits.checked_split(spark.createDataFrame(rows, "battery_id string, split string"))


def test_calibration(spark):
    """Scores that are squared probabilities: both maps bring the error down, isotonic ones keep the order."""
    rng = np.random.default_rng(4)
    p = rng.random(3000)
    df = spark.createDataFrame([(float(q), float(q * q), int(rng.random() < q)) for q in p], "truth double, probability double, label int")
    iso = isotonic.apply_isotonic(isotonic.fit_isotonic(df, "probability", "label"), df, "probability").toPandas().sort_values("probability")
    assert (np.diff(iso.calibrated) >= -1e-12).all() and iso.calibrated.between(0, 1).all()
    assert abs(iso.calibrated - iso.truth).mean() < 0.05 < abs(iso.probability - iso.truth).mean()
    platt = calibrate.fit_platt(df)
    # logit(p^2) is near 2 logit(p) at both ends, so the slope on it lies below one
    assert 0.4 < platt.coefficients[0] < 1.0


def test_out_of_fold_models_and_selection(rows):
    folds = splits.grouped_folds(rows, 3)
    got = {f: models.out_of_fold(rows, folds, 3, f, ["a", "b", "c"], "y") for f in ("linear", "ridge", "elastic_net", "random_forest", "boosted_trees")}
    both = None
    for f, p in got.items():
        assert p.count() == rows.count()
        assert p.groupBy("battery_id").agg(F.count_distinct("fold").alias("k")).filter("k > 1").isEmpty()
        both = p if both is None else both.union(p)
    ranked = models.select_family(both).orderBy("rank").collect()
    assert ranked[0].model == "linear" and ranked[0].mae < 0.15 and [r.rank for r in ranked] == [1, 2, 3, 4, 5]


def test_nested_selection(rows):
    picks = models.nested_selection(rows, splits.grouped_folds(rows, 3), 3, ("linear", "random_forest"), ["a", "b", "c"], "y")
    assert picks.columns == ["fold", "model", "inner_mae", "outer_mae", "n"]
    got = picks.collect()
    assert {r.fold for r in got} == {0, 1, 2} and all(r.model == "linear" and r.outer_mae < 0.2 for r in got)
    assert sum(r.n for r in got) == rows.count()
    assert [tuple(r) for r in models.selection_frequency(picks).collect()] == [("linear", 3, 1.0)]


def test_balanced_risk_classifier(rows):
    df = models.balanced(rows, "label")
    by = df.groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert by[0].w == pytest.approx(by[1].w) == pytest.approx(rows.count() / 2)
    scored = models.risk_classifier(["a", "b", "c"], "label").fit(df).transform(df)
    assert calibrate.ranking_quality(scored.select(vector_to_array("probability")[1].alias("probability"), "label")).first().recall > 0.6


def test_search_prefers_the_weak_penalty(rows):
    df = rows.join(splits.grouped_folds(rows, 3), "battery_id")
    found = dict(models.search(df, ["a", "b", "c"], "y", (0.001, 5.0)))
    assert found[0.001] < 0.15 < found[5.0]


def test_importance_and_ablation(rows):
    model = models.pipeline("linear", ["a", "b", "c"], "y").fit(rows)
    got = {r.feature: r.delta_rmse for r in models.permutation_importance(rows, model, ["a", "b", "c"], "y").collect()}
    assert got["a"] > got["b"] > 1 > 0.05 > abs(got["c"])
    mixed = models.permuted(rows, "a")
    assert sorted(r[0] for r in mixed.select("a").collect()) == sorted(r[0] for r in rows.select("a").collect())
    top = models.ablation(rows, model, ["a", "b", "c"], ["battery_id", "cycle_index"], 2)
    one = {r.feature: r.contribution for r in top.filter("battery_id = 'e0' AND cycle_index = 0").collect()}
    row = rows.filter("battery_id = 'e0' AND cycle_index = 0").first()
    want = sorted([("a", 3 * row.a), ("b", -2 * row.b)], key=lambda x: -abs(x[1]))
    for name, value in want:
        assert one.get(name, value) == pytest.approx(value, abs=0.1)
    assert top.groupBy("battery_id", "cycle_index").count().filter("count <> 2").isEmpty()


def test_tree_importance(rows):
    got = preprocess.tree_importance(rows, ["a", "b", "c"], "y").collect()
    assert [r.feature for r in sorted(got, key=lambda r: -r.importance)] == ["a", "b", "c"]
    assert sum(r.importance for r in got) == pytest.approx(1)


def test_fingerprint_sees_content_alone(rows):
    f = lambda d: tuple(monitoring.fingerprint(d, ["battery_id", "cycle_index", "a"]).first())
    assert f(rows) == f(rows.repartition(9))
    assert f(rows) != f(rows.withColumn("a", F.when(F.col("cycle_index") == 3, F.col("a") + 1e-9).otherwise(F.col("a"))))
    assert f(rows) != f(rows.union(rows.limit(1))) and f(rows.limit(0))[0] == 0


@pytest.mark.parametrize(("x", "dof", "p"), [(3.841458820694124, 1, 0.05), (11.070497693516351, 5, 0.05), (2 * math.log(10), 2, 0.1), (0.0, 3, 1.0), (60.0, 2, math.exp(-30))])
def test_chi_square_tail(spark, x, dof, p):
    got = spark.createDataFrame([(x, dof)], "x double, dof int").select(drift.chi_square_p(F.col("x"), F.col("dof"))).first()[0]
    assert got == pytest.approx(p, rel=1e-6, abs=1e-13)


def test_chi_square_tail_of_many_degrees(spark):
    """Against the sum of Poisson terms, which is the tail for an even number of degrees."""
    rows = [(float(x), dof) for dof in (2, 4, 10, 40, 200) for x in (0.1, 1.0, dof / 2, float(dof), 1.5 * dof, 3.0 * dof + 20)]
    got = spark.createDataFrame(rows, "x double, dof int").select("x", "dof", drift.chi_square_p(F.col("x"), F.col("dof")).alias("p")).collect()
    for r in got:
        h = r.x / 2
        assert r.p == pytest.approx(sum(math.exp(-h + i * math.log(h) - math.lgamma(i + 1)) for i in range(r.dof // 2)), rel=1e-9, abs=1e-14)


def test_ks_tail(spark):
    """The series at its classical points: 1.3581 for 5 % and 1.6276 for 1 %, for samples so large that the correction vanishes."""
    n = 10**12
    df = spark.createDataFrame([(t / math.sqrt(n / 2), n, n) for t in (1.3581, 1.6276, 0.1)], "d double, n long, m long")
    got = [r[0] for r in df.select(drift.ks_p(F.col("d"), F.col("n"), F.col("m"))).collect()]
    assert got == [pytest.approx(0.05, abs=2e-4), pytest.approx(0.01, abs=1e-4), 1.0]
