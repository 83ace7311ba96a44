"""Rules over histories against plain scans of random series, and series whose answer follows from the rule's words."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wanetrack.functions.exprs import history
from wanetrack.functions.ranges import in_ranges, running
from wanetrack.operators import clean, drift, features, fleet, health, metrics, monitoring, splits
from wanetrack.sources import tables

SERIES = "battery_id string, cycle_index int, capacity_ah double"


def frame(spark, series):
    """series: {name: values}; the row number is the cycle."""
    return spark.createDataFrame([(k, i + 1, v) for k, x in series.items() for i, v in enumerate(x)], SERIES)


def first_run_below(values, threshold, length):
    """The first position (from 1) where `length` values in a row are present and at or below the threshold."""
    held = 0
    for i, v in enumerate(values):
        held = held + 1 if v is not None and v <= threshold else 0
        if held == length:
            return i + 2 - length
    return None


@pytest.mark.parametrize("length", [1, 2, 4])
def test_end_of_life_is_the_first_lasting_run(spark, length):
    rng = np.random.default_rng(length)
    series = {f"r{k}": [None if rng.random() < 0.05 else float(round(v, 2)) for v in 1.7 - 0.02 * np.arange(n) + rng.normal(0, 0.15, n)] for k, n in enumerate(rng.integers(1, 45, 30))}
    series |= {
        "at the threshold": [1.5, 1.25, 1.25, 1.25, 1.25], "ends with the record": [2.0, 2.0, 1.0, 1.0, 1.0, 1.0], "one row": [1.0], "never": [2.0, 1.3, 1.9],
        "a null breaks it": [1.0, 1.0, 1.0, None, 1.0, 1.0, 1.0, 1.0], "two runs": [1.0, 1.0, 2.0, 1.1, 1.1, 1.1, 1.1, 2.0, 1.0, 1.0, 1.0, 1.0],
    }
    got = {r.battery_id: r.eol_cycle for r in health.end_of_life(frame(spark, series), 1.25, length).collect()}
    for k, values in series.items():
        assert got.get(k) == first_run_below(values, 1.25, length), k


def test_collapse_cuts_a_final_run_of_dead_rows_only(spark):
    rng = np.random.default_rng(3)
    series = {"dead end": [2.0 - 0.01 * i for i in range(30)] + [0.05] * 40, "dips and recovers": [2.0, 0.05, 0.05, 1.9, 1.8] * 4, "sound": [float(v) for v in 2 - rng.random(20) / 10]}
    kept = {r.battery_id: r.n for r in clean.truncate_collapse(frame(spark, series)).groupBy("battery_id").agg(F.max("cycle_index").alias("n")).collect()}
    assert kept["dead end"] == 30 and kept["sound"] == 20


def test_leading_artifacts_go_and_cycles_start_at_one(spark):
    rows = clean.trim_leading(frame(spark, {"x": [0.1, 0.15] + [1.8 - 0.01 * i for i in range(25)]})).orderBy("cycle_index").collect()
    assert [r.cycle_index for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0].capacity_ah == 1.8


def test_metric_block(spark):
    rng = np.random.default_rng(4)
    y, p = rng.normal(50, 20, 40), rng.normal(52, 20, 40)
    rows = [(float(a), float(b)) for a, b in zip(y, p)] + [(1.0, None), (None, 2.0)]
    m = metrics.regression_metrics(spark.createDataFrame(rows, "y_true double, y_pred double")).first()
    e = p - y
    assert (m.n, m.max_error) == (40, pytest.approx(abs(e).max()))
    assert (m.mae, m.rmse, m.bias) == (pytest.approx(abs(e).mean()), pytest.approx(math.sqrt((e**2).mean())), pytest.approx(e.mean()))


def test_features_are_causal_and_leaks_are_found(spark):
    df = frame(spark, {"a": [2 - 0.01 * k for k in range(60)]})
    gap = features.causality_gap(df, lambda d: features.ewm(features.rolling(d, "capacity_ah", (5,)), "capacity_ah", (5,)), ["capacity_ah_roll5_mean", "capacity_ah_ewm5"])
    assert gap.agg(F.max("gap")).first()[0] < 1e-9
    leaky = lambda d: d.withColumn("next", F.lead("capacity_ah").over(history("battery_id", "cycle_index")))
    assert features.causality_gap(df, leaky, ["next"]).first().gap > 0


@pytest.mark.parametrize("block", [4, 256])
def test_exponential_means(spark, block):
    """Against pandas, with gaps at the start, within and longer than a block."""
    rng = np.random.default_rng(5)
    series = {f"s{k}": [None if rng.random() < 0.3 else float(v) for v in rng.normal(2, 1, n)] for k, n in enumerate((1, 2, 9, 40, 200))}
    series |= {"all null": [None] * 7, "late": [None] * 11 + [1.0, None, 3.0], "long gap": [1.0, 2.0] + [None] * 900 + [5.0, 6.0]}
    got = features.ewm(frame(spark, series), "capacity_ah", (1, 7), block=block).toPandas().sort_values(["battery_id", "cycle_index"])
    for k, values in series.items():
        rows = got[got.battery_id == k]
        for h in (1, 7):
            want = pd.Series(values, dtype=float).ewm(halflife=h, adjust=False).mean()
            assert rows[f"capacity_ah_ewm{h}"].to_numpy(float) == pytest.approx(want.to_numpy(float), nan_ok=True, rel=1e-9)


def test_running_sums_by_ranges(spark):
    """One value that a third of the rows have, nulls, groups, both directions."""
    rng = np.random.default_rng(6)
    rows = [(int(g), None if rng.random() < 0.05 else 7.0 if rng.random() < 0.33 else float(v), int(w)) for g, v, w in zip(rng.integers(0, 3, 500), rng.normal(0, 9, 500), rng.integers(0, 5, 500))]
    pdf = pd.DataFrame(rows, columns=["g", "v", "w"]).dropna()
    df = spark.createDataFrame(rows, "g int, v double, w int")
    for down in (False, True):
        for by in ([], ["g"]):
            got = running(df, "v", {"s": F.col("w"), "n": F.lit(1)}, by, down, ["w"], totals=True, ranges=8).toPandas()
            got = got.sort_values([*by, "v", "w"], ascending=[True] * len(by) + [not down, True]).reset_index(drop=True)
            want = pdf.sort_values([*by, "v", "w"], ascending=[True] * len(by) + [not down, True]).reset_index(drop=True)
            cum = (want.groupby(by) if by else want)["w"].cumsum()
            assert len(got) == len(want) and got["total_n"].sum() == (want.groupby(by).size() ** 2).sum() if by else len(want) ** 2
            last = got.groupby([*by, "v", "w"])["s"].max()
            assert last.to_dict() == cum.groupby([want[c] for c in [*by, "v", "w"]]).max().to_dict()
    assert running(df.limit(0), "v", {"s": F.col("w")}).count() == 0


def test_empty_history(spark):
    empty = frame(spark, {"a": [1.0]}).limit(0)
    assert health.end_of_life(empty).count() == 0
    assert clean.trim_leading(clean.truncate_collapse(empty)).count() == 0
    assert features.ewm(empty, "capacity_ah", (1,)).count() == 0


def test_one_value_spreads_over_ranges(spark):
    """Nine rows in ten are equal in every column; sums and the next value are right, and no range holds more than its share."""
    rng = np.random.default_rng(8)
    v = np.where(rng.random(4000) < 0.9, 5.0, rng.integers(0, 9, 4000).astype(float))
    df = spark.createDataFrame([(float(x), 1) for x in v], "v double, w int").repartition(6)
    laid = in_ranges(df, F.col("v"), ranges=8)
    sizes = [r["count"] for r in laid.groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8
    for down in (False, True):
        got = running(df, "v", {"n": F.lit(1)}, descending=down, following="after", ranges=8).toPandas().sort_values("n")
        want = sorted(v, reverse=down)
        assert got.v.tolist() == want and got.n.tolist() == list(range(1, 4001))
        assert got.after.tolist()[:-1] == want[1:] and np.isnan(got.after.iloc[-1])


def test_repeated_keys_are_refused(spark):
    one = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 6.0)], "battery_id string, cycle_index int, x double")
    two = one.union(one.filter("battery_id = 'a'")).withColumnRenamed("x", "y")
    with pytest.raises(Exception, match="labels: battery_id = a, cycle_index = 1 occurs 2 times"):
        monitoring.attach_labels(one, two).collect()
    with pytest.raises(Exception, match="features"):
        monitoring.attach_labels(two, one).collect()
    with pytest.raises(Exception, match="outcomes"):
        monitoring.match_outcomes(one, two).collect()
    assert monitoring.match_outcomes(two, one).count() == 3


def test_null_keys_match_nothing(spark):
    rows = spark.createDataFrame([(None, 1, 5.0), (None, 1, 6.0), ("b", 1, 6.0)], "battery_id string, cycle_index int, x double")
    other = rows.withColumnRenamed("x", "y")
    assert sorted((r.x, r.y) for r in monitoring.attach_labels(rows, other).collect() if r.y) == [(6.0, 6.0)]
    assert monitoring.attach_labels(rows, other).count() == 3 and monitoring.match_outcomes(rows, other).count() == 1


def test_two_samples_against_plain_counts(spark):
    rng = np.random.default_rng(8)
    a, b = np.round(rng.normal(0, 1, 80), 1), np.round(rng.normal(0.5, 2, 50), 1)
    row = drift.two_sample(*[spark.createDataFrame([(float(v),) for v in x] + [(None,)], "value double") for x in (a, b)]).first()
    at = np.sort(np.concatenate([a, b]))
    d = abs(np.searchsorted(np.sort(a), at, "right") / 80 - np.searchsorted(np.sort(b), at, "right") / 50)
    assert (row.ks, row.n, row.m) == (pytest.approx(d.max()), 80, 50)
    assert row.wasserstein == pytest.approx((d[:-1] * np.diff(at)).sum())


def test_entity_files(spark, tmp_path):
    """The file's name is the id where rows have none; a file with two ids is told, not read."""
    for name, rows in {"e1": "e1,1\ne1,2", "e2": ",5\n,6", "bad": "x,1\ny,2", "e 3": "e 3,9"}.items():
        (tmp_path / f"{name}.csv").write_text("battery_id,value\n" + rows + "\n")
    good, bad = tables.read_entity_files(spark, str(tmp_path / "*.csv"), "battery_id string, value double")
    assert sorted((r.battery_id, r.value) for r in good.collect()) == [("e 3", 9), ("e1", 1), ("e1", 2), ("e2", 5), ("e2", 6)]
    assert [r.file.endswith("bad.csv") for r in bad.collect()] == [True]


def test_holdout_rules(spark):
    df = frame(spark, {k: [1.0] * n for k, n in (("a", 3), ("b", 2), ("c", 2))})
    got = {r.battery_id: r.split for r in splits.entity_holdout(df, test_ids=["b"], val_ids=["c"]).collect()}
    assert got == {"a": "train", "b": "test", "c": "val"}
    with pytest.raises(ValueError, match="'zz'"):
        splits.entity_holdout(df, test_ids=["zz"])
    with pytest.raises(ValueError, match="2 entities"):
        splits.entity_holdout(df.filter("battery_id <> 'a'"))


def test_unknown_ranking_keys_are_named(spark):
    with pytest.raises(ValueError, match="'colour'.*measured_soh"):
        fleet.rank_order("colour")


def test_validation_of_an_empty_table(spark):
    got = {r.check_name: r.n_rows for r in clean.validation_report(frame(spark, {"a": [1.0]}).limit(0)).collect()}
    assert got["empty_table"] == 1 and sum(got.values()) == 1
