"""Steps whose work must grow with their rows, not with the square of them."""

import time

import numpy as np
from pyspark.sql import functions as F

from wanetrack.operators import drift, isotonic, splits


def test_sizes_of_leave_one_out_need_no_rows_times_entities(spark):
    small = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "battery_id string")
    want = {(r.held, r.role): r.n for r in splits.leave_one_out(small).groupBy("held", "role").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {(r.held, r.role): r.n for r in splits.leave_one_out_sizes(small).collect()} == want
    alone = spark.createDataFrame([("a",)], "battery_id string")
    assert [tuple(r) for r in splits.leave_one_out_sizes(alone).collect()] == [("a", "test", 1)]
    many = spark.range(200_000).select(F.col("id").cast("string").alias("battery_id"))
    got = splits.leave_one_out_sizes(many).groupBy("role").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("a"), F.max("n").alias("b")).collect()
    assert {tuple(r) for r in got} == {("test", 200_000, 1, 1), ("train", 200_000, 199_999, 199_999)}


def test_adjusted_p_of_many_tests(spark):
    """Of ten times as many tests; a frame to the last row took minutes for these."""
    tests = spark.range(100_000).select(F.format_string("%06d", "id").alias("feature"), F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(5_000)) / 5_000.0).alias("p_value"))
    began = time.time()
    got = {r.feature: r.adjusted for r in drift.adjust_p(tests).collect()}
    assert time.time() - began < 40
    rows = sorted((r.p_value, r.feature) for r in tests.collect() if r.p_value is not None)
    q = np.array([p * len(rows) / (i + 1) for i, (p, _) in enumerate(rows)])
    want = np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1.0)
    assert len(got) == 100_000 and sum(v is None for v in got.values()) == 100_000 - len(rows)
    assert all(got[f] == w for (_, f), w in zip(rows, want, strict=True))


def test_isotonic_values_of_many_rows_in_one_range(spark):
    """All rows lie in few ranges; a frame to a range's last row took minutes for these."""
    rows = spark.range(100_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(70_000)) / 70_000.0).alias("p"))
    blocks = spark.createDataFrame([(0.1, 0.2, 0.05), (0.4, 0.4, 0.5), (0.8, 0.9, 0.75)], "lo double, hi double, calibrated double")
    began = time.time()
    got = isotonic.apply_isotonic(blocks, rows, "p").toPandas()
    assert time.time() - began < 40
    want = np.interp(got["p"], [0.1, 0.2, 0.4, 0.8, 0.9], [0.05, 0.05, 0.5, 0.75, 0.75])
    assert sorted(got["id"]) == list(range(100_000))
    np.testing.assert_allclose(got["calibrated"], want, atol=1e-12)
