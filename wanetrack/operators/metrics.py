"""Evaluation of predictions: error metrics, horizons, comparisons, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanetrack.functions.arrays import added_up, partials
from wanetrack.functions.exprs import AFTER, finite, median
from wanetrack.functions.quantiles import exact_quantiles
from wanetrack.operators.preprocess import per_column

Y, P = "y_true", "y_pred"


def paired(df: DataFrame, y: str = Y, p: str = P) -> DataFrame:
    """Rows where truth and prediction are both finite."""
    return df.filter(finite(y).isNotNull() & finite(p).isNotNull())


def metric_columns(y: str = Y, p: str = P, floor: float = 1.0) -> list[Column]:
    r = F.col(p) - F.col(y)
    a = F.abs(r)
    ss = F.var_pop(y) * F.count(y)
    return [
        F.count(y).alias("n"), F.avg(a).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(r * r).alias("mse"),
        median(a).alias("median_ae"), F.max(a).alias("max_error"),
        (100 * F.avg(a / F.greatest(F.abs(y), F.lit(floor)))).alias("mape"),
        (100 * F.avg(F.coalesce(F.try_divide(2 * a, F.abs(y) + F.abs(p)), F.lit(0.0)))).alias("smape"),
        F.when(F.var_pop(y) > 0, 1 - F.sum(r * r) / ss).alias("r2"), F.avg(r).alias("bias"), F.stddev_pop(r).alias("error_std"),
        F.avg((a <= 0.2 * F.greatest(F.col(y), F.lit(1.0))).cast("int")).alias("alpha_lambda"),
        F.avg((a <= 10).cast("int")).alias("within_10"), F.avg((a <= 25).cast("int")).alias("within_25"),
    ]


METRICS = ("n", "mae", "rmse", "mse", "median_ae", "max_error", "mape", "smape", "r2", "bias", "error_std", "alpha_lambda", "within_10", "within_25")


def regression_metrics(df: DataFrame, by: Sequence[str] = (), y: str = Y, p: str = P) -> DataFrame:
    """MET1, MET2: the metric block over all rows or by group; pairs that aren't finite are left out.

    Without groups the median is selected in passes, so no task holds all distinct errors.
    """
    rows = paired(df, y, p)
    if by:
        return rows.groupBy(*by).agg(*metric_columns(y, p))
    mid = _quantiles_of(rows, F.abs(F.col(p) - F.col(y)), {"median_ae": 0.5})
    block = rows.agg(*[c for k, c in zip(METRICS, metric_columns(y, p), strict=True) if k != "median_ae"])
    return block.join(F.broadcast(mid), F.lit(True), "cross").select(*METRICS)  # one row each


def _quantiles_of(df: DataFrame, value: Column, names: dict[str, float]) -> DataFrame:
    """One row: the value's quantiles by name."""
    q = exact_quantiles(df.select(value.alias("v")), ["v"], tuple(names.values()))
    return q.select(*[F.col("quantiles")[i].alias(k) for i, k in enumerate(names)])


def prognostic_horizon(df: DataFrame, alpha: float = 0.2, entity: str = "battery_id", y: str = Y, p: str = P) -> DataFrame:
    """MET3: (entity, horizon): the largest true life from which on all later rows stay inside the cone."""
    inside = (F.abs(F.col(p) - F.col(y)) <= alpha * F.greatest(F.col(y), F.lit(1.0))).cast("int")
    w = Window.partitionBy(entity).orderBy(F.desc(y)).rowsBetween(0, AFTER)
    rows = paired(df, y, p).withColumn("_in", inside).withColumn("_all", F.min("_in").over(w))
    return rows.groupBy(entity).agg(F.max(F.when(F.col("_all") == 1, F.col(y))).alias("horizon"))


def mean_horizon(horizons: DataFrame) -> DataFrame:
    """MET4."""
    return horizons.agg(F.avg("horizon").alias("mean_horizon"), F.count("horizon").alias("n_with_horizon"), F.count(F.lit(1)).alias("n_entities"))


def residual_summary(df: DataFrame, y: str = Y, p: str = P) -> DataFrame:
    """MET5: quantiles, moments (bias-corrected skewness and excess kurtosis) and correlation with the truth."""
    rows = paired(df, y, p).withColumn("_r", F.col(p) - F.col(y))
    qs = (0.05, 0.25, 0.5, 0.75, 0.95)
    n = F.count("_r").cast("double")
    g1, g2 = F.skewness("_r"), F.kurtosis("_r")
    held = _quantiles_of(rows, F.col("_r"), {f"q{int(q * 100):02d}": q for q in qs})
    moments = rows.agg(
        F.avg("_r").alias("mean"),
        F.stddev_pop("_r").alias("std"), (g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"), F.corr("_r", y).alias("corr_truth"),
    )
    return F.broadcast(held).join(moments, F.lit(True), "cross")  # one row each


def poisson_weights(seeds: np.ndarray, replicates: int) -> np.ndarray:
    """How often each row is drawn in each replicate: Poisson(1) numbers from a hash of the row's seed and the replicate's number."""
    with np.errstate(over="ignore"):
        z = seeds.astype(np.uint64)[:, None] + (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    steps = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 12)]))
    return np.searchsorted(steps, (z >> np.uint64(11)).astype(float) * 2.0**-53)


def bootstrap_mae(df: DataFrame, replicates: int = 100, level: float = 0.9, seed: int = 7, y: str = Y, p: str = P) -> DataFrame:
    """MET6: percentile interval of the mean absolute error; Poisson(1) weights stand for drawing with replacement.

    A row's weights in all replicates come from a hash of the row, so they do not depend on
    how rows are dealt; each task adds up two numbers a replicate, and no row is written
    more than once. Rows that are equal in every column are drawn together.
    """
    rows = paired(df, y, p).select(F.abs(F.col(p) - F.col(y)).cast("double").alias("a"), F.xxhash64(F.lit(seed), *df.columns).alias("h"))

    def run(batches):
        total = np.zeros((2, replicates))
        for batch in batches:
            a, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for i in range(0, len(a), 4096):
                w = poisson_weights(h[i : i + 4096], replicates)
                total += [a[i : i + 4096] @ w, w.sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["k", "sums"])

    summed = added_up(partials(rows, run, "k int, sums array<double>"), "k")  # one row
    reps = summed.select(F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"), "sums")
    reps = reps.select(F.try_divide(F.col("sums")[F.col("b")], F.col("sums")[F.col("b") + replicates]).alias("mae"))
    tail = (1 - level) / 2
    return reps.agg(F.percentile("mae", F.lit(tail)).alias("low"), F.percentile("mae", F.lit(1 - tail)).alias("high"), F.avg("mae").alias("mean"))


def skill(df: DataFrame, baseline: str, by: Sequence[str] = (), y: str = Y, p: str = P) -> DataFrame:
    """MET7: error against a baseline's on the rows that both have."""
    rows = paired(paired(df, y, p), y, baseline)
    mae, ref = F.avg(F.abs(F.col(p) - F.col(y))), F.avg(F.abs(F.col(baseline) - F.col(y)))
    return rows.groupBy(*by).agg(F.count(y).alias("n"), mae.alias("mae"), ref.alias("baseline_mae"), F.try_divide(ref - mae, ref).alias("skill"))


def compare_models(df: DataFrame, metric: str = "mae") -> DataFrame:
    """MET8: metric block a model with its rank; models without a value come last."""
    m = regression_metrics(df, ["model"])
    return m.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last(metric), "model")))


def common_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JON5: the rows whose key every model scored."""
    scored = paired(df)
    models = scored.agg(F.count_distinct("model").alias("all_models"))
    full = scored.groupBy(*keys).agg(F.count_distinct("model").alias("k")).join(F.broadcast(models), F.col("k") == F.col("all_models"))
    return scored.join(full.select(*keys), list(keys), "left_semi")  # models: one row


def pooled_folds(df: DataFrame) -> DataFrame:
    """MET10: by model the pooled error, the spread of fold errors and the worst fold. df has a fold column."""
    folds = df.groupBy("model", "fold").agg(
        F.avg(F.abs(F.col(P) - F.col(Y))).alias("mae"), F.count(P).alias("scored"), F.count(F.lit(1)).alias("rows"),
        F.sum(F.abs(F.col(P) - F.col(Y))).alias("s"),
    )
    return folds.groupBy("model").agg(
        (F.sum("s") / F.sum("scored")).alias("mae"), (F.sum("scored") / F.sum("rows")).alias("coverage"),
        F.stddev_samp("mae").alias("fold_std"), F.max_by("fold", F.struct("mae", "fold")).alias("worst_fold"), F.count("mae").alias("folds"),
    )


#: Fixed values of the surveyed error analysis: edges of the true life, and the quantile from which errors are the worst.
LIFE_EDGES, WORST = (0.0, 10.0, 25.0, 50.0, 100.0), 0.9


def error_bands(df: DataFrame, edges: Sequence[float] = LIFE_EDGES, y: str = Y, p: str = P) -> DataFrame:
    """MET11: (band, low, n, mae, bias, p90) by band of the true life.

    Bands hold their lower edge and not the upper one, the last is open; rows below the
    first edge belong to none, and bands without rows are left out.
    """
    r = F.col(p) - F.col(y)
    within = [(F.col(y) >= lo) & (F.col(y) < edges[i + 1] if i + 1 < len(edges) else F.lit(True)) for i, lo in enumerate(edges)]
    rows = paired(df, y, p).select(r.alias("r"), *[F.when(w, F.abs(r)).alias(f"a{i}") for i, w in enumerate(within)])
    names = [f"a{i}" for i in range(len(edges))]
    inside = lambda c: F.when(F.col(c).isNotNull(), F.col("r"))
    stats = per_column(rows, names, n=F.count, mae=F.avg, bias=lambda c: F.avg(inside(c)))
    p90 = exact_quantiles(rows, names, (0.9,)).select("feature", F.col("quantiles")[0].alias("p90"))
    band = F.substring("feature", 2, 9).cast("int")
    lows = F.lit(list(map(float, edges)))
    return stats.join(F.broadcast(p90), "feature").filter("n > 0").select(band.alias("band"), lows[band].alias("low"), "n", "mae", "bias", "p90")


def _worst(df: DataFrame, q: float, y: str, p: str) -> DataFrame:
    """Rows with abs_error and `threshold`, its q quantile."""
    rows = paired(df, y, p).withColumn("abs_error", F.abs(F.col(p) - F.col(y)))
    cut = _quantiles_of(rows, F.col("abs_error"), {"threshold": q})
    return rows.join(F.broadcast(cut), F.lit(True), "cross")  # one row


def error_analysis(df: DataFrame, q: float = WORST, y: str = Y, p: str = P) -> DataFrame:
    """MET11: one row: the q quantile of the error, rows at or above it, and their mean true life beside all rows'."""
    rows = _worst(df, q, y, p)
    bad = F.col("abs_error") >= F.col("threshold")
    return rows.agg(
        F.max("threshold").alias("threshold"), F.count_if(bad).alias("n_worst"), F.avg(F.when(bad, F.col(y))).alias("worst_mean_true"), F.avg(y).alias("overall_mean_true")
    )


def worst_entities(df: DataFrame, q: float = WORST, entity: str = "battery_id", y: str = Y, p: str = P) -> DataFrame:
    """MET11: (entity, n): how many of its rows are among the worst."""
    return _worst(df, q, y, p).filter("abs_error >= threshold").groupBy(entity).agg(F.count(F.lit(1)).alias("n"))


def worst_rows(df: DataFrame, q: float = WORST, n: int = 15, y: str = Y, p: str = P, key: str = "prediction_id") -> DataFrame:
    """MET11: the n largest errors at or above the q quantile."""
    return _worst(df, q, y, p).filter("abs_error >= threshold").drop("threshold").orderBy(F.desc("abs_error"), key).limit(n)


def latest_predictions(df: DataFrame, entity: str = "battery_id", order: str = "cycle_index", y: str = Y, p: str = P) -> DataFrame:
    """MET12: the latest scored row of each entity and its mean error; entities never scored stay."""
    g = df.groupBy(entity).agg(
        F.max(order).alias("last_order"),
        F.max_by(F.struct(order, p), F.when(F.col(p).isNotNull(), F.col(order))).alias("s"),
        F.avg(F.abs(F.col(p) - F.col(y))).alias("mae"),
    )
    return g.select(
        entity, "last_order", F.col(f"s.{order}").alias("scored_order"), F.col(f"s.{p}").alias("prediction"), "mae",
        F.when(F.col("s").isNull(), "insufficient_history").otherwise("scored").alias("status"),
    )


#: Whether a larger value is better.
DIRECTIONS = {"mae": False, "rmse": False, "median_ae": False, "mape": False, "r2": True, "within_10": True, "alpha_lambda": True}


def champion(metrics: DataFrame, metric: str = "mae") -> DataFrame:
    """MET13: the best model by a finite metric, ties by name."""
    by = F.desc(metric) if DIRECTIONS[metric] else F.asc(metric)
    return metrics.filter(finite(metric).isNotNull()).orderBy(by, "model").limit(1)
