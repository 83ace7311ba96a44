"""Probabilities: scores, reliability, ranking quality, thresholds, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wanetrack.functions.exprs import finite
from wanetrack.functions.ranges import running

PROB, LABEL = "probability", "label"


def brier(df: DataFrame, p: str = PROB, y: str = LABEL) -> DataFrame:
    """CAL1."""
    return df.agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))


def reliability(df: DataFrame, bins: int = 10, p: str = PROB, y: str = LABEL) -> DataFrame:
    """CAL2: equal bins, left-closed, 1.0 in the last; empty bins stay."""
    edge = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    k = F.size(F.filter(edge, lambda e: F.col(p) >= e))
    got = df.withColumn("bin", k).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"), F.avg(y).alias("observed")
    )
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def expected_calibration_error(curve: DataFrame) -> DataFrame:
    """CAL3."""
    return curve.agg((F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("observed"))) / F.sum("n")).alias("ece"))


def _steps(df: DataFrame, p: str, y: str) -> DataFrame:
    """One row a distinct score, from high to low, with counts so far."""
    g = df.groupBy(F.col(p).alias("threshold")).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    g = running(g, "threshold", {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True, totals=True)
    return g.withColumnsRenamed({"total_tp": "P", "total_fp": "N"})


def ranking_quality(df: DataFrame, cut: float = 0.5, p: str = PROB, y: str = LABEL) -> DataFrame:
    """CAL4: ROC area with half credit for ties, average precision, and the confusion counts at a cut."""
    s = _steps(df, p, y)
    areas = s.agg(
        F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), F.max("P") * F.max("N")).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("P")).alias("average_precision"),
    )
    hit, one = F.col(p) >= cut, F.col(y) == 1
    c = df.agg(
        F.count_if(hit & one).alias("tp"), F.count_if(hit & ~one).alias("fp"), F.count_if(~hit & one).alias("fn"), F.count_if(~hit & ~one).alias("tn")
    )
    out = areas.join(c, F.lit(True), "cross")  # one row each
    return out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn(
        "recall", F.try_divide("tp", F.col("tp") + F.col("fn"))
    ).withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def against_order(df: DataFrame, order: str = "cycle_index", p: str = PROB, y: str = LABEL) -> DataFrame:
    """CAL4: one row: rows, positives, and both areas of the score beside those of the order key alone, on the same rows.

    Positives that are the last rows of each entity are ranked well by counting cycles, so
    an area says something only next to this one. With one class alone all areas are null
    and `beats_order` is too. Rows without a finite score or a label are left out.
    """
    rows = df.filter(finite(p).isNotNull() & F.col(y).isNotNull()).select(F.col(p).cast("double").alias(p), F.col(order).cast("double").alias("_o"), F.col(y).cast("int").alias(y))
    sides = {"": p, "_order": "_o"}
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("n_positive"))
    both = (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n"))
    for k, c in sides.items():
        areas = ranking_quality(rows, p=c, y=y).select(F.col("roc_auc").alias(f"roc_auc{k}"), F.col("average_precision").alias(f"average_precision{k}"))
        n = n.join(F.broadcast(areas), F.lit(True), "cross")  # one row each
    shown = [F.when(both, F.col(f"{m}{k}")).alias(f"{m}{k}") for k in sides for m in ("roc_auc", "average_precision")]
    beats = F.when(both, F.col("average_precision") > F.col("average_precision_order")).alias("beats_order")
    return n.select("n", F.coalesce("n_positive", F.lit(0)).alias("n_positive"), *shown, beats)


def threshold_search(df: DataFrame, how: str = "f1", min_recall: float = 0.8, p: str = PROB, y: str = LABEL) -> DataFrame:
    """CAL5: the least threshold among the distinct scores, 0 and 1, with the best value."""
    ends = df.select(F.lit(0.0).alias(p), F.lit(0).cast(dict(df.dtypes)[y]).alias(y), F.lit(0.0).alias("_w")).limit(1)
    ends = ends.union(ends.select(F.lit(1.0), y, "_w"))
    rows = df.select(F.col(p).cast("double"), y, F.lit(1.0).alias("_w")).union(ends)
    g = rows.groupBy(F.col(p).alias("threshold")).agg(
        F.sum(F.col("_w") * F.col(y)).alias("pos"), F.sum(F.col("_w") * (1 - F.col(y))).alias("neg")
    )
    g = running(g, "threshold", {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True, totals=True)
    g = g.select("threshold", "tp", "fp", F.col("total_tp").alias("P"), F.col("total_fp").alias("N"))
    recall, precision = F.try_divide("tp", "P"), F.try_divide("tp", F.col("tp") + F.col("fp"))
    value = {
        "f1": F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P")),
        "youden": recall - F.try_divide("fp", "N"),
        "precision_at_recall": F.when(recall >= min_recall, precision),
    }[how]
    g = g.withColumn("value", F.round(value, 12)).filter("value is not null")
    return g.orderBy(F.desc("value"), "threshold").limit(1).select("threshold", "value")


def fit_platt(df: DataFrame, p: str = PROB, y: str = LABEL):
    """CAL6: logistic calibration of the log odds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = df.select(F.col(p), F.col(y)).withColumn("_x", F.log(x / (1 - x))).withColumn("_y", F.col(y).cast("double"))
    rows = VectorAssembler(inputCols=["_x"], outputCol="_f").transform(rows)
    return LogisticRegression(featuresCol="_f", labelCol="_y", probabilityCol="_p", rawPredictionCol="_r", regParam=1e-8, maxIter=50).fit(rows)
