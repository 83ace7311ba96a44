"""Health indicators, end-of-life labels, horizons and bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanetrack.functions.exprs import BEFORE, clip, finite, first_run, history, ladder, median, trailing, whole

ID, ORDER, VALUE = "battery_id", "cycle_index", "capacity_ah"


def derive_health(
    df: DataFrame, window: int = 5, nominal: float | None = 2.0, value: str = VALUE, entity: str = ID, order: str = ORDER
) -> DataFrame:
    """HLT1: trailing-median capacity, state of health, fade and equivalent full cycles. nominal None: the first value."""
    w = history(entity, order)
    smooth = median(value).over(trailing(entity, order, window))
    ref = F.lit(nominal) if nominal else F.first(value).over(w.rowsBetween(BEFORE, 0))
    return (
        df.withColumn("capacity_smooth_ah", smooth).withColumn("reference_capacity_ah", ref)
        .withColumn("soh", F.col("capacity_smooth_ah") / F.col("reference_capacity_ah"))
        .withColumn("capacity_fade_ah", F.first("capacity_smooth_ah").over(w.rowsBetween(BEFORE, 0)) - F.col("capacity_smooth_ah"))
        .withColumn("equivalent_full_cycles", F.sum(value).over(w.rowsBetween(BEFORE, 0)) / F.col("reference_capacity_ah"))
    )


def soh_reference(
    df: DataFrame, how: str = "mean_first", n: int = 5, nominal: float = 2.0, value: str = VALUE, entity: str = ID, order: str = ORDER
) -> DataFrame:
    """HLT2: (entity, soh_reference): nominal, first valid value, or mean of the first n valid ones."""
    if how == "nominal":
        return df.select(entity).distinct().withColumn("soh_reference", F.lit(nominal))
    n = 1 if how == "first" else n
    valid = df.filter(finite(value) > 0).withColumn("_rn", F.row_number().over(history(entity, order)))
    return valid.filter(F.col("_rn") <= n).groupBy(entity).agg(F.avg(value).alias("soh_reference"))


def soh_target(df: DataFrame, reference: DataFrame, value: str = VALUE, low: float = 0.2, high: float = 1.2, entity: str = ID) -> DataFrame:
    """HLT3: value over the entity's reference, clipped, and whether it was."""
    raw = F.col(value) / F.col("soh_reference")
    return df.join(reference, entity).withColumn("soh_target", clip(raw, low, high)).withColumn(
        "soh_clipped", ~raw.between(low, high)
    )


def forecast_label(df: DataFrame, source: str, horizon: int, entity: str = ID, order: str = ORDER) -> DataFrame:
    """HLT4: the source's value `horizon` rows ahead; null for the last rows."""
    return df.withColumn(f"{source}_in_{horizon}", F.lead(source, horizon).over(history(entity, order)))


def health_band(soh: str | Column) -> Column:
    """HLT5."""
    x = F.col(soh) if isinstance(soh, str) else soh
    return ladder((x.isNull(), "unknown"), (x >= 0.9, "healthy"), (x >= 0.8, "slightly_degraded"), (x >= 0.7, "warning"), otherwise="critical")


def end_of_life(
    df: DataFrame, threshold: Column | float = 1.4, persistence: int = 3, value: str = VALUE, entity: str = ID, order: str = ORDER
) -> DataFrame:
    """LBL1: (entity, eol_cycle): the first of `persistence` complete consecutive rows at or below the threshold, else null."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    low = F.coalesce(F.col(value) <= t, F.lit(False))
    marked = df.withColumn("_start", first_run(low, order, entity, persistence))
    return marked.groupBy(entity).agg(F.min("_start").alias("eol_cycle"))


def eol_capacity(df: DataFrame, fraction: float = 0.7, nominal: float | None = None, value: str = VALUE, entity: str = ID, order: str = ORDER) -> DataFrame:
    """LBL2: (entity, eol_capacity): a part of the nominal or of the first value."""
    ref = F.lit(nominal) if nominal else F.min_by(value, order)
    return df.groupBy(entity).agg((fraction * ref).alias("eol_capacity"))


def attach_rul(
    df: DataFrame, eol: DataFrame, cap: float | None = 125.0, min_labelled: int = 25, entity: str = ID, order: str = ORDER
) -> DataFrame:
    """LBL3: remaining life of rows up to the end of life; censored entities and thin ones go."""
    rows = df.join(eol.filter("eol_cycle is not null"), entity).filter(F.col(order) <= F.col("eol_cycle"))
    raw = (F.col("eol_cycle") - F.col(order)).cast("double")
    rows = rows.withColumn("rul_raw_cycles", raw).withColumn("rul_cycles", F.least(raw, F.lit(cap)) if cap else raw)
    rows = rows.withColumn("life_fraction", F.col(order) / F.col("eol_cycle"))
    return rows.withColumn("_n", F.count(F.lit(1)).over(whole(entity))).filter(F.col("_n") >= min_labelled).drop("_n")


def target_transform(c: str) -> Column:
    """LBL4."""
    return F.log1p(c)


def target_inverse(c: str | Column) -> Column:
    """LBL4: never below zero."""
    return F.greatest(F.expm1(c), F.lit(0.0))


def risk_labels(df: DataFrame, horizons: Sequence[int] = (30, 20, 50), rul: str = "rul_raw_cycles") -> DataFrame:
    """LBL5: 1 where the remaining life is within the horizon, null where it isn't known."""
    return df.withColumns({f"fails_in_{h}": F.when(F.col(rul).isNotNull(), (F.col(rul) <= h).cast("int")) for h in horizons})


def risk_band(p: str | Column) -> Column:
    """LBL6."""
    x = F.col(p) if isinstance(p, str) else p
    return ladder((x.isNull(), "unknown"), (x < 0.2, "low"), (x < 0.5, "moderate"), (x < 0.8, "high"), otherwise="critical")


def entity_summary(df: DataFrame, eol: DataFrame, nominal: float = 2.0, value: str = VALUE, entity: str = ID, order: str = ORDER) -> DataFrame:
    """LBL7."""
    g = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min_by(value, order).alias("start_value"), F.max_by(value, order).alias("end_value"),
        F.avg("ambient_temperature_c").alias("ambient_mean"),
    )
    return (
        g.join(eol, entity, "left")
        .withColumn("start_soh", F.col("start_value") / nominal).withColumn("end_soh", F.col("end_value") / nominal)
        .withColumn("reached_eol", F.col("eol_cycle").isNotNull())
        .withColumn("fade_pct", 100 * (F.col("start_value") - F.col("end_value")) / F.col("start_value"))
    )


def comparison_summary(df: DataFrame, value: str = VALUE, temperature: str = "temperature_max_c", ambient: str = "ambient_temperature_c", entity: str = ID, order: str = ORDER) -> DataFrame:
    """AGG1: per entity cycles, first and last value, percent lost, hottest reading and mean ambient temperature."""
    g = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_cycles"), F.min_by(value, order).alias("value_start"), F.max_by(value, order).alias("value_end"),
        F.max(temperature).alias("temperature_max"), F.avg(ambient).alias("ambient"),
    )
    return g.withColumn("fade_pct", F.try_divide(100 * (F.col("value_start") - F.col("value_end")), F.col("value_start")))
