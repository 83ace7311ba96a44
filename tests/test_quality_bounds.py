"""Scores that lie just on the least score of a class."""

from wanetrack.operators import quality


def test_a_sum_of_penalties_on_a_bound_keeps_its_class(spark):
    """Short, duplicate rows, out of order, out of range: 1 - (0.15 + 0.25 + 0.2 + 0.05) is 0.35, which is still poor."""
    rows = [("a", i, max(i, 2), 1.0 if i else 9.5) for i in range(20)]
    df = spark.createDataFrame(rows, "battery_id string, arrival long, cycle_index int, x double")
    ranges = spark.createDataFrame([("x", 0.0, 9.0)], "feature string, low double, high double")
    got = quality.quality_scores(df, ["x"], ranges, bounds={}, arrival="arrival").first()
    assert got.failed_checks == "duplicates,ordering,ood"
    assert (got.score, got.quality_class) == (0.35, "poor")
