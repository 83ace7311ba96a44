"""Causal window features. One window specification serves them all, so Spark shuffles and sorts once."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanetrack.functions.exprs import BEFORE, finite, history, median, trailing, whole

ID, ORDER = "battery_id", "cycle_index"


def rolling(df: DataFrame, c: str, windows: Sequence[int], fraction: float = 0.5, entity: str = ID, order: str = ORDER) -> DataFrame:
    """WIN1, WIN2: trailing mean, sample deviation, least, largest, range, and the value's distance from the mean."""
    out: dict[str, Column] = {}
    for n in windows:
        w, x = trailing(entity, order, n), F.col(c)
        enough = F.count(x).over(w) >= ceil(n * fraction)
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            out[f"{c}_roll{n}_{name}"] = F.when(enough, f(x).over(w))
        out[f"{c}_roll{n}_range"] = F.when(enough, F.max(x).over(w) - F.min(x).over(w))
        out[f"{c}_roll{n}_dev"] = F.when(enough, x - F.avg(x).over(w))
    return df.withColumns(out)


def ewm(df: DataFrame, c: str, half_lives: Sequence[int], entity: str = ID, order: str = ORDER, block: int = 256) -> DataFrame:
    """WIN3: exponentially weighted means by half-life, unadjusted; a null repeats the mean and its weight decays on.

    A value moves the mean by m <- w m + (1 - w) x, where w falls with the rows since the
    last value. Within a block of rows these maps are composed by running sums (the
    product of a block's w stays far from underflow); the blocks' maps are composed once
    an entity, over a list with one element a block, and handed back to the rows.
    """
    for a in half_lives:
        if block / a > 900:
            raise ValueError(f"blocks of {block} rows underflow at half-life {a}")
    x = F.col(c).cast("double")
    past = history(entity, order)
    df = df.withColumn("_i", F.row_number().over(past)).withColumn("_x", x)
    last = F.max(F.when(F.col("_x").isNotNull(), F.col("_i"))).over(past.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_gap", F.col("_i") - last).withColumn("_block", F.floor((F.col("_i") - 1) / block))
    here = Window.partitionBy(entity, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    names, sums = {}, {}
    for h in half_lives:
        keep = 0.5 ** (1 / h)
        old = F.pow(F.lit(keep), F.col("_gap"))
        w = F.when(F.col("_x").isNull(), 1.0).when(F.col("_gap").isNull(), 0.5).otherwise(F.greatest(old / (old + (1 - keep)), F.lit(1e-100)))
        first = F.col("_x").isNotNull() & F.col("_gap").isNull()  # the first value of all is the mean itself
        names |= {f"_l{h}": F.log(w), f"_v{h}": F.when(first, F.col("_x")).when(F.col("_x").isNotNull(), (1 - w) * F.col("_x")).otherwise(0.0)}
        sums |= {f"_l{h}": F.sum(f"_l{h}").over(here)}
    df = df.withColumns(names).withColumns(sums)
    df = df.withColumns({f"_v{h}": F.exp(f"_l{h}") * F.sum(F.col(f"_v{h}") * F.exp(-F.col(f"_l{h}"))).over(here) for h in half_lives})
    df = df.withColumn("_any", F.coalesce(F.max(F.col("_x").isNotNull().cast("int")).over(past.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    ends = df.groupBy(entity, "_block").agg(*[F.max_by(F.struct(F.exp(f"_l{h}").alias("w"), F.col(f"_v{h}").alias("v")), "_i").alias(f"_m{h}") for h in half_lives])
    lists = ends.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("_block", *[f"_m{h}" for h in half_lives]))).alias("_all"))
    def before_blocks(h: int) -> Column:
        start = F.struct(F.lit(0.0).alias("m"), F.array().cast("array<double>").alias("out"))

        def go(s: Column, e: Column) -> Column:
            return F.struct((e[f"_m{h}"]["w"] * s["m"] + e[f"_m{h}"]["v"]).alias("m"), F.concat(s["out"], F.array(s["m"])).alias("out"))

        return F.aggregate("_all", start, go)["out"].alias(f"_c{h}")

    maps = [before_blocks(h) for h in half_lives]
    carried = lists.select(entity, F.inline(F.arrays_zip(F.transform("_all", lambda e: e["_block"]).alias("_block"), *maps)))
    carried = carried.toDF(entity, "_block", *[f"_c{h}" for h in half_lives])
    out = df.join(carried, [entity, "_block"])
    mean = {f"{c}_ewm{h}": F.when(F.col("_any") == 1, F.exp(f"_l{h}") * F.col(f"_c{h}") + F.col(f"_v{h}")) for h in half_lives}
    return out.withColumns(mean).drop("_i", "_x", "_gap", "_block", "_any", *[f"{k}{h}" for h in half_lives for k in ("_l", "_v", "_c")])


def lags(df: DataFrame, c: str, steps: Sequence[int], entity: str = ID, order: str = ORDER) -> DataFrame:
    """WIN4: earlier values, differences and relative changes (null over zero)."""
    w, out = history(entity, order), {}
    for k in steps:
        past = F.lag(c, k).over(w)
        out |= {f"{c}_lag{k}": past, f"{c}_diff{k}": F.col(c) - past, f"{c}_pct{k}": F.try_divide(F.col(c) - past, past)}
    return df.withColumns(out)


def slopes(df: DataFrame, c: str, windows: Sequence[int], entity: str = ID, order: str = ORDER) -> DataFrame:
    """WIN5: least-squares slope over the last n positions; null unless all n values are there."""
    df = df.withColumn("_k", F.row_number().over(history(entity, order)))
    out = {}
    for n in windows:
        w = trailing(entity, order, n)
        out[f"{c}_slope{n}"] = F.when(F.count(c).over(w) == n, F.regr_slope(c, "_k").over(w))
    return df.withColumns(out).drop("_k")


def from_first(df: DataFrame, c: str, entity: str = ID, order: str = ORDER) -> DataFrame:
    """WIN6: ratio and difference to the entity's first row."""
    first = F.first(c).over(history(entity, order).rowsBetween(BEFORE, 0))
    ok = first.isNotNull() & (F.abs(first) > 1e-12)
    return df.withColumns({f"{c}_ratio_first": F.when(ok, F.col(c) / first), f"{c}_delta_first": F.when(ok, F.col(c) - first)})


def expanding(df: DataFrame, c: str, entity: str = ID, order: str = ORDER) -> DataFrame:
    """WIN7."""
    w = history(entity, order).rowsBetween(BEFORE, 0)
    fs = (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))
    return df.withColumns({f"{c}_exp_{n}": f(c).over(w) for n, f in fs})


def positions(df: DataFrame, entity: str = ID, order: str = ORDER) -> DataFrame:
    """WIN8."""
    k = F.row_number().over(history(entity, order)).cast("double")
    return df.withColumns({"pos": k, "pos_log": F.log1p(k), "pos_inv": 1 / k})


def cumulative(df: DataFrame, entity: str = ID, order: str = ORDER) -> DataFrame:
    """WIN9: energy and discharge hours so far."""
    w = history(entity, order).rowsBetween(BEFORE, 0)
    return df.withColumns({
        "cum_energy_wh": F.sum("energy_throughput_wh").over(w), "cum_discharge_h": F.sum(F.col("discharge_duration_s") / 3600).over(w),
    })


def interactions(df: DataFrame) -> DataFrame:
    """WIN10."""
    r, q = F.col("internal_resistance_ohm"), F.col("capacity_ah")
    return df.withColumns({
        "r_times_c": r * q, "c_over_r": q / F.nullif(r, F.lit(0.0)), "t_excess": F.col("temperature_max_c") - F.col("ambient_temperature_c"),
        "charge_ratio": F.col("discharge_duration_s") / F.nullif(F.col("charge_duration_s"), F.lit(0.0)),
    })


def finish(df: DataFrame, columns: Sequence[str], warmup: int = 10, entity: str = ID, order: str = ORDER) -> DataFrame:
    """WIN11: infinities to null, warm-up rows off, and only then the last known value forward."""
    df = df.withColumns({c: finite(c) for c in columns}).filter(F.col(order) > warmup)
    w = history(entity, order).rowsBetween(BEFORE, 0)
    return df.withColumns({c: F.last(c, True).over(w) for c in columns})


def numeric_features(df: DataFrame, exclude: Sequence[str] = (), prefixes: Sequence[str] = ("rul_", "eol_", "fails_in_")) -> list[str]:
    """WIN12: the numeric columns that are neither identifiers nor labels."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in df.dtypes if t in kinds and c not in exclude and not c.startswith(tuple(prefixes))]


def causality_gap(df: DataFrame, build, columns: Sequence[str], part: float = 0.6, entity: str = ID, order: str = ORDER) -> DataFrame:
    """WIN13: (feature, gap): the largest relative difference between features of a prefix and of the whole history."""
    n = F.count(F.lit(1)).over(whole(entity))
    prefix = df.withColumn("_n", n).filter(F.col(order) <= F.floor(F.col("_n") * part)).drop("_n")
    a = build(df).select(entity, order, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = build(prefix).select(entity, order, *[F.col(c).alias(f"b_{c}") for c in columns])
    x, y = F.col("s.a"), F.col("s.b")
    gap = F.when(x.isNull() & y.isNull(), 0.0).when(x.isNull() | y.isNull(), 1.0).otherwise(F.abs(x - y) / F.greatest(F.abs(x), F.lit(1.0)))
    rows = F.array(*[F.struct(F.lit(c).alias("f"), F.col(f"a_{c}").cast("double").alias("a"), F.col(f"b_{c}").cast("double").alias("b")) for c in columns])
    long = b.join(a, [entity, order]).select(F.explode(rows).alias("s"))
    return long.groupBy(F.col("s.f").alias("feature")).agg(F.max(gap).alias("gap"))


def scoreable(df: DataFrame, warmup: int = 10, window: int = 0, order: str = ORDER) -> DataFrame:
    """WIN14: whether a row is past the warm-up (and the sequence window before it)."""
    first = warmup + 1 + max(window - 1, 0)
    return df.withColumn("first_scoreable", F.lit(first)).withColumn("scoreable", F.col(order) >= first)


def sequences(df: DataFrame, columns: Sequence[str], label: str, window: int = 8, stride: int = 4, entity: str = ID, order: str = ORDER) -> DataFrame:
    """WIN15: the last `window` rows as an array of arrays, every `stride` rows, with the last row's label."""
    w = trailing(entity, order, window)
    df = df.withColumn("_rn", F.row_number().over(history(entity, order)))
    df = df.withColumn("sequence", F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(w))
    return df.filter((F.size("sequence") == window) & ((F.col("_rn") - window) % stride == 0)).select(
        entity, order, "sequence", F.col(label).alias("label")
    )


def too_short(df: DataFrame, window: int = 8, entity: str = ID) -> DataFrame:
    """WIN15: (entity, n) of the entities that have fewer rows than a window, so that no sequence comes of them."""
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < window)


def recent_trend(
    df: DataFrame, c: str, rows: int = 20, min_points: int = 5, per: int = 10, relative: bool = False, entity: str = ID, order: str = ORDER
) -> DataFrame:
    """WIN16: slope over the order key of the last rows, per `per` steps, or in percent of their median."""
    last = df.withColumn("_rn", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(order)))).filter(F.col("_rn") <= rows)
    x = finite(c)
    g = last.groupBy(entity).agg(
        F.regr_slope(x, F.col(order)).alias("_s"), F.count(x).alias("_n"), F.count_distinct(F.when(x.isNotNull(), F.col(order))).alias("_d"),
        median(x).alias("_m"),
    )
    slope = per * F.col("_s")
    slope = F.when(F.abs("_m") > 1e-12, 100 * slope / F.abs("_m")) if relative else slope
    return g.select(entity, F.when((F.col("_n") >= min_points) & (F.col("_d") >= 2), slope).alias(f"{c}_trend"))


def entity_trends(df: DataFrame, entity: str = ID, order: str = ORDER) -> DataFrame:
    """WIN17: fade, health, temperature and resistance trends; health falls back to capacity."""
    out = df.select(entity).distinct()
    for c in ("capacity_ah", "soh", "temperature_max_c", "internal_resistance_ohm"):
        out = out.join(recent_trend(df, c, relative=c == "capacity_ah", entity=entity, order=order), entity, "left")
    return out.select(
        entity, (-F.col("capacity_ah_trend")).alias("fade_trend"), F.coalesce("soh_trend", "capacity_ah_trend").alias("soh_trend"),
        F.col("temperature_max_c_trend").alias("temperature_trend"), F.col("internal_resistance_ohm_trend").alias("resistance_trend"),
    )


def duty_rate(df: DataFrame, ts: str = "ts", rows: int = 10, entity: str = ID, order: str = ORDER) -> DataFrame:
    """WIN18: cycles a day over the last timestamped rows; null below `rows` of them or without a span."""
    last = df.filter(F.col(ts).isNotNull()).withColumn("_rn", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(order))))
    g = last.filter(F.col("_rn") <= rows).groupBy(entity).agg(
        F.count(F.lit(1)).alias("_n"), (F.max(order) - F.min(order)).alias("_c"),
        ((F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 86_400_000_000).alias("_d"),
    )
    return g.select(entity, F.when((F.col("_n") >= rows) & (F.col("_d") > 0), F.col("_c") / F.col("_d")).alias("cycles_per_day"))


def replay(df: DataFrame, stride: int = 10, order: str = ORDER) -> DataFrame:
    """WIN19: the entity's state at every stride-th row. Features are causal, so a filter is enough."""
    return df.filter(F.col(order) % stride == 0)
