"""Preprocessing fitted on training rows: fills, filters, selection, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wanetrack.functions.arrays import cross_products
from wanetrack.functions.exprs import finite
from wanetrack.functions.quantiles import exact_quantiles


def unpivot(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, feature, value: one row a value."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.inline(rows))


def per_column(df: DataFrame, columns: Sequence[str], **aggs) -> DataFrame:
    """(feature, aggregates): one wide partial aggregation, without a row a value."""
    wide = df.agg(*[f(c).alias(f"{n}|{c}") for c in columns for n, f in aggs.items()])
    rows = [F.struct(F.lit(c).alias("feature"), *[F.col(f"`{n}|{c}`").alias(n) for n in aggs]) for c in columns]
    return wide.select(F.inline(F.array(*rows)))


def fallback_values(train: DataFrame, columns: Sequence[str], how: str = "median") -> DataFrame:
    """PRE1: (feature, fallback)."""
    if how == "median":
        return exact_quantiles(train, columns, (0.5,)).select("feature", F.col("quantiles")[0].alias("fallback"))
    f = {"mean": lambda c: F.avg(finite(c)), "zero": lambda c: F.lit(0.0)}[how]
    return per_column(train, columns, fallback=f)


def variance_filter(train: DataFrame, columns: Sequence[str], threshold: float = 1e-10) -> DataFrame:
    """PRE2: (feature, variance, kept)."""
    out = per_column(train, columns, variance=lambda c: F.var_samp(finite(c)))
    return out.withColumn("kept", F.coalesce(F.col("variance") > threshold, F.lit(False)))


#: A sum of squares that centring brings below this share of itself is rounding: the column is constant there.
_FLAT = 1e-12


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, rho) of every ordered pair of columns over the rows where both are finite; null where one is constant."""
    c = cross_products(df, columns)
    spread = lambda ss, s: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    va, vb = spread("saa", "sa"), spread("sbb", "sb")
    varies = (va > _FLAT * F.col("saa")) & (vb > _FLAT * F.col("sbb"))
    rho = (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(va) / F.sqrt(vb)
    return c.select("a", "b", F.when((F.col("n") > 1) & varies, rho).alias("rho"))


def correlation_prune(train: DataFrame, columns: Sequence[str], limit: float = 0.98) -> DataFrame:
    """PRE3: (feature, dropped): a column goes if a later one correlates with it."""
    bad = correlations(train, columns).filter(F.abs("rho") > limit).select(F.col("a").alias("feature")).distinct()
    names = train.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(bad.withColumn("dropped", F.lit(True)), "feature", "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))


def top_by_f(train: DataFrame, columns: Sequence[str], label: str, k: int) -> DataFrame:
    """PRE4: (feature, f, rank) of the k largest univariate F statistics."""
    wide = per_column(train, columns, rho=lambda c: F.corr(c, label), n=lambda c: F.regr_count(c, label))
    r2 = F.col("rho") * F.col("rho")
    out = wide.select("feature", (r2 * (F.col("n") - 2) / (1 - r2)).alias("f"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("f"), "feature"))).filter(F.col("rank") <= k)


def mutual_information(train: DataFrame, columns: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """PRE4: (feature, mi): mutual information with the label over equal-width bins, in nats, from joint counts."""
    long = unpivot(train, columns, [label]).filter(finite("value").isNotNull() & finite(label).isNotNull())
    own = Window.partitionBy("feature")

    def bin_(c: str):
        lo, hi = F.min(c).over(own), F.max(c).over(own)
        return F.coalesce(F.least(F.floor(F.try_divide((F.col(c) - lo) * bins, hi - lo)), F.lit(bins - 1)), F.lit(0))

    joint = long.select("feature", bin_("value").alias("x"), bin_(label).alias("y")).groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by))
    joint = joint.select("feature", "n", total("x").alias("nx"), total("y").alias("ny"), total().alias("nn"))
    return joint.groupBy("feature").agg(F.sum(F.col("n") / F.col("nn") * F.log(F.col("n") * F.col("nn") / (F.col("nx") * F.col("ny")))).alias("mi"))


def tree_importance(train: DataFrame, columns: Sequence[str], label: str, trees: int = 10, seed: int = 42) -> DataFrame:
    """PRE4: (feature, importance) from a random forest."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = VectorAssembler(inputCols=list(columns), outputCol="_f", handleInvalid="skip").transform(train.filter(F.col(label).isNotNull()))
    model = RandomForestRegressor(featuresCol="_f", labelCol=label, numTrees=trees, maxDepth=5, seed=seed).fit(rows)
    found = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)]
    return train.sparkSession.createDataFrame(found, "feature string, importance double")


def scaler(train: DataFrame, columns: Sequence[str], how: str = "robust") -> DataFrame:
    """PRE5: (feature, center, scale); a scale of zero is one."""
    if how == "robust":
        q = F.col("quantiles")
        out = exact_quantiles(train, columns, (0.25, 0.5, 0.75)).select("feature", q[1].alias("center"), (q[2] - q[0]).alias("scale"))
    else:
        center, scale = {
            "standard": (F.avg, F.stddev_pop), "minmax": (F.min, lambda c: F.max(c) - F.min(c)), "none": (lambda c: F.lit(0.0), lambda c: F.lit(1.0)),
        }[how]
        out = per_column(train, columns, center=center, scale=scale)
    return out.withColumn("scale", F.when(F.coalesce("scale", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("scale")))


def transform(df: DataFrame, fallback: DataFrame, scale: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """PRE6: null for infinities, fallback then 0 for nulls, scaled, in the fixed order. The statistics are one row a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    stats = fallback.join(scale, "feature").groupBy().agg(
        *[F.max(F.when(F.col("feature") == c, F.struct("fallback", "center", "scale"))).alias(f"_s_{c}") for c in columns]
    )
    s = lambda c, k: F.col(f"_s_{c}")[k]
    out = [((F.coalesce(finite(c), s(c, "fallback"), F.lit(0.0)) - s(c, "center")) / s(c, "scale")).alias(c) for c in columns]
    return df.join(F.broadcast(stats), F.lit(True), "cross").select(*keys, *out)  # one row of statistics


def inverse(df: DataFrame, scale: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """PRE5: back to the original units."""
    stats = scale.groupBy().agg(*[F.max(F.when(F.col("feature") == c, F.struct("center", "scale"))).alias(f"_s_{c}") for c in columns])
    out = [(F.col(c) * F.col(f"_s_{c}")["scale"] + F.col(f"_s_{c}")["center"]).alias(c) for c in columns]
    return df.join(F.broadcast(stats), F.lit(True), "cross").select(*keys, *out)


def reference_ranges(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PRE7: (feature, low, high)."""
    return per_column(train, columns, low=lambda c: F.min(finite(c)), high=lambda c: F.max(finite(c)))
