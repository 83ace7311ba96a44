"""Summaries of sampled steps (charge, discharge, impedance) and their as-of enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanetrack.functions.exprs import BEFORE

KEYS = ["battery_id", "step_no"]


def in_bounds(df: DataFrame) -> DataFrame:
    return df.withColumn("voltage", F.when(F.col("voltage").between(0, 6), F.col("voltage"))).withColumn(
        "temperature", F.when(F.col("temperature").between(-50, 150), F.col("temperature"))
    )


def step_summary(samples: DataFrame, step_type: str = "discharge", min_samples: int = 5) -> DataFrame:
    """TRC1, TRC2: one row a step with levels, drops, rises and the voltage slope."""
    df = in_bounds(samples).filter(F.col("step_type") == step_type)
    v, i, t = "voltage", "current_a", "temperature"
    out = df.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_samples"), (F.max("time_s") - F.min("time_s")).alias("duration_s"),
        F.avg(v).alias("v_mean"), F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.stddev_pop(v).alias("v_std"),
        (F.min_by(v, "time_s") - F.max_by(v, "time_s")).alias("v_drop"), F.avg(i).alias("i_mean"), F.stddev_pop(i).alias("i_std"),
        F.avg(t).alias("t_mean"), F.max(t).alias("t_max"), (F.max(t) - F.min_by(t, "time_s")).alias("t_rise"),
        F.regr_slope(v, "time_s").alias("v_slope"),
    )
    return out.filter(F.col("n_samples") >= min_samples)


def knee(samples: DataFrame) -> DataFrame:
    """TRC3: voltage left of the steepest fall, time of the least voltage, mean and least dV/dt."""
    w = Window.partitionBy(*KEYS).orderBy("time_s")
    dt = F.lead("time_s").over(w) - F.col("time_s")
    rate = F.when(dt > 0, (F.lead("voltage").over(w) - F.col("voltage")) / dt)
    return (
        samples.withColumn("dvdt", rate).groupBy(*KEYS)
        .agg(
            F.min_by("voltage", F.when(F.col("dvdt").isNotNull(), F.struct("dvdt", "time_s"))).alias("v_knee"),
            F.min_by("time_s", F.struct("voltage", "time_s")).alias("time_v_min"),
            F.avg("dvdt").alias("dvdt_mean"), F.min("dvdt").alias("dvdt_min"),
        )
    )


def trapezoid(y: Column, t: Column, w) -> Column:
    return (y + F.lag(y).over(w)) / 2 * (t - F.lag(t).over(w))


def integrals(samples: DataFrame) -> DataFrame:
    """TRC4: energy (Wh) and charge (Ah) by the trapezoid rule over complete samples."""
    w = Window.partitionBy(*KEYS).orderBy("time_s")
    full = samples.filter(F.col("voltage").isNotNull() & F.col("current_a").isNotNull() & F.col("time_s").isNotNull())
    t, i = F.col("time_s"), F.abs("current_a")
    full = full.select(*KEYS, trapezoid(F.abs(F.col("voltage") * F.col("current_a")), t, w).alias("e"), trapezoid(i, t, w).alias("q"))
    return full.groupBy(*KEYS).agg(
        F.coalesce(F.sum("e") / 3600, F.lit(0.0)).alias("energy_wh"), F.coalesce(F.sum("q") / 3600, F.lit(0.0)).alias("charge_ah")
    )


def charge_phases(samples: DataFrame, part: float = 0.9) -> DataFrame:
    """TRC5: time at constant current (|I| at least a part of its maximum at the left sample), and its ratio."""
    own = Window.partitionBy(*KEYS)
    w = own.orderBy("time_s")
    df = samples.filter("step_type = 'charge'").select(
        *KEYS, (F.lead("time_s").over(w) - F.col("time_s")).alias("dt"),
        (F.abs("current_a") >= part * F.max(F.abs("current_a")).over(own)).alias("cc"),
    )
    out = df.groupBy(*KEYS).agg(F.sum(F.when(F.col("cc"), F.coalesce("dt", F.lit(0.0))).otherwise(0.0)).alias("cc_time"), F.sum("dt").alias("total"))
    return out.select(*KEYS, "cc_time", (F.col("total") - F.col("cc_time")).alias("cv_time"), F.try_divide("cc_time", "total").alias("cc_ratio"))


def clean_impedance(c: str, low: float = 0.0, high: float = 10.0) -> Column:
    """TRC6."""
    return F.when((F.col(c) > low) & (F.col(c) < high), F.col(c))


def enrich_discharges(samples: DataFrame) -> DataFrame:
    """TRC7: each discharge with the latest earlier charge and impedance summaries, taken whole, and a counter."""
    steps = samples.groupBy("battery_id", "step_no", "step_type").agg(
        F.avg("voltage").alias("v_mean"), F.max("temperature").alias("t_max"), F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy("battery_id").orderBy("step_no").rowsBetween(BEFORE, -1)
    last = lambda kind: F.last(F.when(F.col("step_type") == kind, F.struct("step_no", "v_mean", "t_max")), True).over(w)
    df = steps.withColumn("charge", last("charge")).withColumn("impedance", last("impedance")).filter("step_type = 'discharge'")
    nth = F.row_number().over(Window.partitionBy("battery_id").orderBy("step_no"))
    return df.select(
        "battery_id", "step_no", nth.alias("discharge_no"), "v_mean", F.col("charge.step_no").alias("charge_step"),
        F.col("charge.v_mean").alias("charge_v_mean"), F.col("impedance.step_no").alias("impedance_step"),
        (F.col("v_mean") / F.col("charge.v_mean")).alias("v_efficiency"),
    )
