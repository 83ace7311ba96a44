"""Fits pass over their rows several times, so what made these rows must not run again."""

from pyspark.sql import functions as F

from wanetrack.operators import models as X
from wanetrack.operators import splits as S


def test_folds_are_fitted_from_written_rows(spark):
    rows = spark.range(240).select((F.col("id") % 12).cast("string").alias("battery_id"), F.floor(F.col("id") / 12).cast("int").alias("cycle_index"))
    rows = rows.withColumn("x", F.col("cycle_index") / 20.0).withColumn("rul", F.when(F.col("cycle_index") < 18, 20.0 - F.col("cycle_index")))
    folds = S.grouped_folds(rows, 3)
    out = X.out_of_fold(rows, folds, 3, ["ridge", "linear"], ["x"], "rul")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    got = out.groupBy("model").agg(F.count("y_pred").alias("n"), F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae")).collect()
    assert {r.model: r.n for r in got} == {"ridge": 216, "linear": 216}
    assert {r.model: r.mae for r in got}["linear"] < 1e-6
    picks = X.nested_selection(rows, folds, 3, ("ridge", "linear"), ["x"], "rul").collect()
    assert [(r.fold, r.model, r.n) for r in sorted(picks)] == [(f, "linear", 72) for f in range(3)]
    assert all(r.inner_mae < 1e-6 and r.outer_mae < 1e-6 for r in picks)
