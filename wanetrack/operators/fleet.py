"""Fleet decisions: recommendation and priority ladders, plans, composite ranking, statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanetrack.functions.exprs import ladder
from wanetrack.functions.quantiles import exact_quantiles
from wanetrack.operators.health import health_band, risk_band
from wanetrack.operators.quality import quality_class

ID = "battery_id"
WIDTH = "interval_width"


def with_derived(records: DataFrame) -> DataFrame:
    """interval_width, health_class, data_quality_class, and the risk that rules may use (`r`)."""
    return (
        records.withColumn(WIDTH, F.col("rul_upper_bound") - F.col("rul_lower_bound"))
        .withColumn("health_class", health_band("measured_soh")).withColumn("data_quality_class", quality_class("data_quality_score"))
        .withColumn("r", F.when(~F.col("risk_is_experimental"), F.col("failure_risk")))
        .withColumn("L", F.coalesce("rul_lower_bound", "predicted_rul"))
    )


#: Fixed values of the surveyed policies: planning life and risk of each rung, and trends that call for advice.
REC_LIFE, REC_RISK = {"urgent": 5, "replace": 15, "inspect": 40}, {"urgent": 0.85, "replace": 0.60, "inspect": 0.30}
ADVICE_TRENDS = {"temperature": 0.5, "resistance": 2.0, "fade": 1.0}
CRITICAL_SOH, PRIORITY_RISK, PRIORITY_LIFE = 0.70, {"P0": 0.85, "P1": 0.60}, {"P0": 5, "P1": 15, "P2": 40}
FADE_HIGH, FADE_MEDIUM, WIDE_INTERVAL = 1.0, 0.5, 60


def _advice() -> list[Column]:
    hot = F.col("temperature_trend_c_per_10") >= ADVICE_TRENDS["temperature"]
    hard = (F.col("resistance_trend_pct_per_10") >= ADVICE_TRENDS["resistance"]) | (F.col("fade_trend_pct_per_10") >= ADVICE_TRENDS["fade"])
    return [F.when(hot, "reduce_heat"), F.when(hard, "reduce_charging")]


def recommendation(df: DataFrame) -> DataFrame:
    """REC1: the first rung that holds, and the advisories beside it (joined by commas); df from with_derived.

    Heat and charging advisories stand beside the three severe rungs. Without a severe
    rung the first of them is the recommendation itself.
    """
    low, r, h = F.col("L"), F.col("r"), F.col("health_class")
    advice = F.array_compact(F.array(*_advice()))
    rung = ladder(
        ((F.col("status") != "success") | (F.col("data_quality_class") == "insufficient"), "insufficient_data"),
        ((low <= REC_LIFE["urgent"]) | (r >= REC_RISK["urgent"]), "urgent"),
        ((low <= REC_LIFE["replace"]) | (r >= REC_RISK["replace"]) | (h == "critical"), "replace"),
        ((low <= REC_LIFE["inspect"]) | (r >= REC_RISK["inspect"]) | (h == "warning"), "inspect"),
        (F.size(advice) > 0, "advice"), (h == "slightly_degraded", "monitor"), otherwise="normal",
    )
    severe = rung.isin("urgent", "replace", "inspect")
    beside = F.when(severe, advice).when(rung == "advice", F.slice(advice, 2, 2)).otherwise(F.array().cast("array<string>"))
    return df.withColumn("recommendation", F.when(rung == "advice", F.get(advice, F.lit(0))).otherwise(rung)).withColumn("advisories", F.concat_ws(",", beside))


def evidence(df: DataFrame) -> DataFrame:
    """REC2: the sentences behind a recommendation, joined; facts that are unknown are left out, whole cycles are rounded down."""
    low, point = F.floor("rul_lower_bound").cast("int"), F.floor("predicted_rul").cast("int")
    trend = lambda name, c, unit: F.when(F.col(c).isNotNull(), F.format_string(f"{name} trend %+.2f {unit} in 10 cycles.", c))
    say = [
        F.when(F.col("measured_soh").isNotNull(), F.format_string("Health %.2f (%s).", "measured_soh", "health_class")),
        F.when(point.isNotNull() & low.isNotNull(), F.format_string("Life %d cycles, at least %d.", point, low)).when(point.isNotNull(), F.format_string("Life %d cycles.", point)),
        F.when(F.col("r").isNotNull(), F.format_string("Failure risk %.2f (%s).", "r", risk_band("r"))).when(
            F.col("failure_risk").isNotNull(), F.lit("Failure risk is experimental and not used.")
        ),
        trend("Temperature", "temperature_trend_c_per_10", "C"), trend("Resistance", "resistance_trend_pct_per_10", "%%"), trend("Fade", "fade_trend_pct_per_10", "%%"),
        F.format_string("Data quality %s.", "data_quality_class"),
    ]
    return df.withColumn("evidence", F.concat_ws(" ", *say))


def priority(df: DataFrame) -> DataFrame:
    """FLT1: priority P0 to P5 or INSUFFICIENT_DATA, the rule that fired first, and all that was triggered; df from with_derived.

    A critical data warning makes any scored entity P0. A risk that is withheld as
    experimental is told among the triggered.
    """
    low, r, soh, fade = F.col("L"), F.col("r"), F.col("measured_soh"), F.col("fade_trend_pct_per_10")
    rules = [
        ("INSUFFICIENT_DATA", "not_scored", (F.col("status") != "success") | (F.col("data_quality_class") == "insufficient")),
        ("P0", "soh_floor", soh <= CRITICAL_SOH),
        *[(p, n, c & (low <= PRIORITY_LIFE[p])) for p in ("P0", "P1") for n, c in (("risk_and_life", r >= PRIORITY_RISK[p]), ("life_alone", r.isNull()))],
        ("P2", "health", F.col("health_class") == "warning"), ("P2", "life", low <= PRIORITY_LIFE["P2"]), ("P2", "fade", fade >= FADE_HIGH),
        ("P3", "degrading", (F.col("health_class") == "slightly_degraded") & (fade >= FADE_MEDIUM)),
        ("P5", "uncertain", (F.col(WIDTH) >= WIDE_INTERVAL) | F.col("data_quality_class").isin("poor", "acceptable") | (F.col("out_of_distribution_feature_count") > 0)),
    ]
    df = df.withColumn("priority", ladder(*[(c, p) for p, _, c in rules], otherwise="P4")).withColumn(
        "rule", ladder(*[(c, n) for _, n, c in rules], otherwise="routine")
    )
    warned = F.coalesce(F.col("critical_data_warning"), F.lit(False)) if "critical_data_warning" in df.columns else F.lit(False)
    scored = F.col("priority") != "INSUFFICIENT_DATA"
    told = F.concat_ws(
        ",", F.when(scored & r.isNull() & F.col("failure_risk").isNotNull(), "risk_withheld"), "rule", F.when(scored & warned, "critical_data_warning")
    )
    return df.withColumn("triggered", told).withColumn("priority", F.when(scored & warned, "P0").otherwise(F.col("priority")))


#: Fixed values of the surveyed policies, down to BUCKET_ENDS: actions, inspection windows, score weights, horizons, workload.
ACTIONS = {
    "P0": "replace_now", "P1": "schedule_replacement", "P2": "inspect", "P3": "monitor_closely", "P4": "routine", "P5": "collect_data",
    "INSUFFICIENT_DATA": "collect_data",
}
WINDOWS = {"P0": 0, "P1": 5, "P2": 10, "P3": 20}


def action(c: str = "priority") -> Column:
    """FLT2."""
    return F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.col(c)]


def inspection_window(df: DataFrame, rate: str | None = None) -> DataFrame:
    """FLT3: cycles until inspection, shortened to the planning life; days only where a duty rate is known."""
    base = ladder(*[(F.col("priority") == p, n) for p, n in WINDOWS.items()])
    cycles = F.when(base.isNotNull(), F.greatest(F.least(base, F.floor("L")), F.lit(0))).cast("bigint")
    df = df.withColumn("inspect_within_cycles", cycles)
    days = F.try_divide("inspect_within_cycles", rate) if rate else F.lit(None).cast("double")
    return df.withColumn("inspect_within_days", days)


#: Component: weight in the composite score.
WEIGHTS = {"risk": 0.30, "rul": 0.20, "rul_lower": 0.20, "soh": 0.15, "fade": 0.05, "width": 0.05, "quality": 0.05}


def _components() -> dict[str, Column]:
    unit = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return {
        "risk": unit(F.col("r")), "rul": unit(1 - F.col("predicted_rul") / 100), "rul_lower": unit(1 - F.col("rul_lower_bound") / 100),
        "soh": unit((1 - F.col("measured_soh")) / 0.3), "fade": unit(F.col("fade_trend_pct_per_10") / 3), "width": unit(F.col(WIDTH) / 100),
        "quality": unit(1 - F.col("data_quality_score")),
    }


def composite_score(df: DataFrame, floor: float = 95.0) -> DataFrame:
    """FLT4: weighted components over the weights that are available, times 100; at least the floor for P0."""
    parts = _components()
    top = reduce(lambda a, b: a + b, [F.coalesce(WEIGHTS[k] * c, F.lit(0.0)) for k, c in parts.items()])
    low = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), F.lit(WEIGHTS[k])).otherwise(0.0) for k, c in parts.items()])
    score = F.try_divide(100 * top, low)
    score = F.when(F.col("priority") == "P0", F.greatest(score, F.lit(floor))).when(F.col("priority") != "INSUFFICIENT_DATA", score)
    return df.withColumn("priority_score", score)


def score_breakdown(df: DataFrame, entity: str = ID) -> DataFrame:
    """FLT5: one row a component: value, weight and share of the score."""
    parts = _components()
    low = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), F.lit(WEIGHTS[k])).otherwise(0.0) for k, c in parts.items()])
    rows = F.array(*[
        F.struct(F.lit(k).alias("component"), c.alias("value"), F.lit(WEIGHTS[k]).alias("weight"), F.try_divide(100 * WEIGHTS[k] * c, low).alias("points"))
        for k, c in parts.items()
    ])
    return df.filter("priority != 'INSUFFICIENT_DATA'").select(entity, F.inline(rows))


HORIZONS = ("near", "medium", "long", "beyond", "insufficient")
HORIZON_ENDS = {"near": 20, "medium": 50, "long": 100}
NEAR_RISK, NEAR_SOH, SURE_RATIO, FAIR_RATIO = 0.6, 0.72, 0.5, 1.0
BUCKET_ENDS = {"next_10": 10, "next_30": 30, "next_50": 50}


def replacement_horizon(df: DataFrame) -> DataFrame:
    """FLT6: near, medium, long or beyond by the planning life, raised by risk, health and priority; with confidence."""
    low = F.col("L")
    base = ladder((F.col("priority") == "INSUFFICIENT_DATA", "insufficient"), (low.isNull(), "insufficient"), *[(low <= n, h) for h, n in HORIZON_ENDS.items()], otherwise="beyond")
    raised = F.when(base == "insufficient", base).when(
        (F.col("r") >= NEAR_RISK) | (F.col("measured_soh") <= NEAR_SOH) | F.col("priority").isin("P0", "P1"), "near"
    ).otherwise(base)
    ratio = F.try_divide(F.col(WIDTH), F.greatest("predicted_rul", F.lit(1.0)))
    conf = ladder(
        (raised == "insufficient", "none"), ((ratio <= SURE_RATIO) & (F.col("data_quality_class") == "good"), "high"), (ratio <= FAIR_RATIO, "medium"), otherwise="low"
    )
    return df.withColumn("horizon", raised).withColumn("confidence", conf)


def replacement_summary(df: DataFrame, horizons: Sequence[str] = HORIZONS) -> DataFrame:
    """FLT7: entities a horizon, empty horizons kept; by upper bound (optimistic) and lower bound (conservative)."""
    within = HORIZON_ENDS
    wide = df.agg(
        *[F.count_if(F.col("horizon") == h).alias(f"n_{h}") for h in horizons],
        *[F.count_if(F.col("rul_upper_bound") <= n).alias(f"o_{h}") for h, n in within.items()],
        *[F.count_if(F.col("rul_lower_bound") <= n).alias(f"c_{h}") for h, n in within.items()],
    )
    zero = F.lit(None).cast("bigint")
    rows = [
        F.struct(F.lit(h).alias("horizon"), F.col(f"n_{h}").alias("n"), (F.col(f"o_{h}") if h in within else zero).alias("optimistic"),
                 (F.col(f"c_{h}") if h in within else zero).alias("conservative"))
        for h in horizons
    ]
    return wide.select(F.inline(F.array(*rows)))


BUCKETS = ("immediate", "next_10", "next_30", "next_50", "beyond_50", "monitor_only", "insufficient")


def workload(df: DataFrame) -> DataFrame:
    """FLT8: entities a workload bucket, empty ones kept, with their part of those evaluated.

    n_if_lower and n_if_upper count the bucket as it would be by the lower and the upper
    end of the life interval, entities without one by their planning life.
    """

    def bucket(life: Column) -> Column:
        return ladder(
            (F.col("priority") == "INSUFFICIENT_DATA", "insufficient"), (life.isNull(), "monitor_only"), (F.col("priority") == "P0", "immediate"),
            *[(life <= n, b) for b, n in BUCKET_ENDS.items()], otherwise="beyond_50",
        )

    low = F.col("L")
    marked = df.select(bucket(low).alias("bucket"), bucket(F.coalesce("rul_lower_bound", low)).alias("if_lower"), bucket(F.coalesce("rul_upper_bound", low)).alias("if_upper"))
    wide = marked.agg(
        *[F.count_if(F.col(c) == x).alias(f"{p}{x}") for x in BUCKETS for c, p in (("bucket", ""), ("if_lower", "l_"), ("if_upper", "u_"))],
        F.count_if(F.col("bucket") != "insufficient").alias("evaluated"),
    )
    rows = [
        F.struct(F.lit(x).alias("bucket"), F.col(x).alias("n"), F.col(f"l_{x}").alias("n_if_lower"), F.col(f"u_{x}").alias("n_if_upper"), (F.lit(None).cast("double") if x == "insufficient" else F.try_divide(100.0 * F.col(x), F.col("evaluated"))).alias("pct"))
        for x in BUCKETS
    ]
    return wide.select(F.inline(F.array(*rows)))


def health_distribution(df: DataFrame) -> DataFrame:
    """FLT9: entities a health class among those with one, and its part."""
    known = df.filter("status = 'success' and health_class != 'unknown'")
    g = known.groupBy("health_class").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))


def risk_distribution(df: DataFrame) -> DataFrame:
    """FLT10."""
    ok = df.filter("status = 'success'")
    q = exact_quantiles(ok, ["r"], (0.25, 0.5, 0.75, 0.9)).select(*[F.col("quantiles")[i].alias(f"q{k}") for i, k in enumerate((25, 50, 75, 90))])
    counts = ok.agg(
        F.count("r").alias("n"), F.count_if(F.col("r").isNull()).alias("n_unknown"), F.avg("r").alias("mean"),
        F.count_if(F.col("r") > 0.5).alias("above_50"), F.count_if(F.col("r") > 0.8).alias("above_80"),
    )
    return counts.join(F.broadcast(q), F.lit(True), "cross")  # one row each


def maintenance_summary(df: DataFrame) -> DataFrame:
    """FLT11: entities a priority with its action; the ids of P0, sorted."""
    return df.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("priority") == "P0", F.col(ID))))).alias("critical_ids")).withColumn("action", action())


def fleet_statistics(df: DataFrame, quantities: Sequence[str] = ("measured_soh", "predicted_rul", "r", WIDTH)) -> DataFrame:
    """FLT12: (quantity, n, missing, mean, median), over scored entities only."""
    ok = df.filter("status = 'success'")
    mid = exact_quantiles(ok, quantities, (0.5,)).select(F.col("feature").alias("quantity"), F.col("quantiles")[0].alias("median"))
    wide = ok.agg(*[f(c).alias(f"{k}_{c}") for c in quantities for k, f in (("n", F.count), ("mean", F.avg))], F.count(F.lit(1)).alias("all"))
    rows = [F.struct(F.lit(c).alias("quantity"), F.col(f"n_{c}").alias("n"), (F.col("all") - F.col(f"n_{c}")).alias("missing"), F.col(f"mean_{c}").alias("mean")) for c in quantities]
    return wide.select(F.inline(F.array(*rows))).join(F.broadcast(mid), "quantity")  # a row a quantity


def snapshot_summary(df: DataFrame, entity: str = ID) -> DataFrame:
    """FLT13: every submitted entity accounted for once."""
    return df.agg(
        F.count(F.lit(1)).alias("submitted"), F.count_distinct(entity).alias("entities"), F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "insufficient_data").alias("insufficient"),
    ).withColumn("complete", (F.col("submitted") == F.col("succeeded") + F.col("failed") + F.col("insufficient")) & (F.col("submitted") == F.col("entities")))


def snapshot_trend(df: DataFrame, snapshot: Sequence[str], value: str) -> DataFrame:
    """FLT14: count, median and mean of a value a snapshot."""
    return df.groupBy(*snapshot).agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("median"), F.avg(value).alias("mean"))


def passport(df: DataFrame, metadata: DataFrame, entity: str = ID) -> DataFrame:
    """FLT15: lifecycle status, readiness for recycling, and where each field comes from.

    metadata: one row an entity, any columns. An entity is ready for recycling when its
    first life has ended and every supplied field is there; else `awaits` names what is
    lacking, or says that it is still in use.
    """
    soh = F.col("measured_soh")
    given = [c for c in metadata.columns if c != entity]
    out = df.join(metadata, entity, "left")
    life = ladder((soh.isNull(), "unknown"), (soh <= CRITICAL_SOH, "end_of_first_life"), (soh <= 0.8, "second_life_candidate"), otherwise="in_service")
    lacking = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in given])
    ended = F.coalesce(soh <= CRITICAL_SOH, F.lit(False))
    source = lambda c, there, absent: F.when(F.col(c).isNull(), absent).otherwise(there).alias(f"{c}_source")
    return out.select(
        entity, "measured_soh", "predicted_rul", life.alias("lifecycle_status"), (ended & (lacking == "")).alias("recycling_ready"),
        F.when(~ended, "in_use").otherwise(lacking).alias("awaits"), *given, source("measured_soh", "measured", "not_available"),
        source("predicted_rul", "predicted", "not_available"), *[source(c, "supplied", "not_supplied") for c in given],
    )


#: Ranking key: whether its largest value comes first.
RANK_KEYS = {
    "priority": False, "priority_score": True, "r": True, "predicted_rul": False, "rul_lower_bound": False, "measured_soh": False,
    "soh_trend_pct_per_10": False, "fade_trend_pct_per_10": True, "temperature_trend_c_per_10": True, "resistance_trend_pct_per_10": True,
    "data_quality_score": False, WIDTH: True,
}


def rank_order(key: str, entity: str = ID) -> list[Column]:
    """By priority, the higher score comes first within one; other keys tie by id alone."""
    if key not in RANK_KEYS:
        raise ValueError(f"unknown ranking key {key!r}; known are {', '.join(RANK_KEYS)}")
    by = F.desc_nulls_last(key) if RANK_KEYS[key] else F.asc_nulls_last(key)
    return [by, *([F.desc_nulls_last("priority_score")] if key == "priority" else []), F.asc(entity)]


def rank_fleet(df: DataFrame, key: str = "priority_score", limit: int | None = None, tail: bool = True) -> DataFrame:
    """RNK1: ordered by one key, nulls last, ties by id; `limit` is the report's own top-k.

    Entities that were not scored come last, by id, or not at all without `tail`.
    """
    order = rank_order(key)
    scored = F.col("status") == "success"
    if tail:
        key_of = F.when(scored, F.col(key))
        df = df.withColumn("_key", key_of).orderBy(F.desc(scored), F.desc_nulls_last("_key") if RANK_KEYS[key] else F.asc_nulls_last("_key"), *order[1:]).drop("_key")
    else:
        df = df.filter(scored).orderBy(*order)
    return df.limit(limit) if limit is not None else df


def ranking_table(df: DataFrame, key: str = "priority_score", entity: str = ID) -> DataFrame:
    """RNK2: rank numbers. One total order over the fleet's latest-state rows."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order(key, entity))))


def page(df: DataFrame, number: int, size: int, key: str = "priority_score") -> DataFrame:
    """RNK3: one page of the ranking with the true total."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    part = df.orderBy(*rank_order(key)).offset((number - 1) * size).limit(size)
    return part.join(F.broadcast(total), F.lit(True), "cross")  # total: one row


def critical_list(df: DataFrame) -> DataFrame:
    """RNK4."""
    return df.filter(F.col("priority").isin("P0", "P1")).orderBy("priority", F.desc_nulls_last("priority_score"), ID)
