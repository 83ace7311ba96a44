"""Data-quality scores, latest states, gating and recommendations."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanetrack.functions.exprs import finite, history, ladder

ID, ORDER = "battery_id", "cycle_index"


#: Fixed values of the surveyed quality policy: the least score of each class.
CLASSES = {"good": 0.80, "acceptable": 0.60, "poor": 0.35}


def quality_class(score: str = "score") -> Column:
    x = F.col(score)
    return ladder((x.isNull(), "unknown"), *[(x >= v, k) for k, v in CLASSES.items()], otherwise="insufficient")


def ood_features(df: DataFrame, ranges: DataFrame, columns: Sequence[str], entity: str = ID) -> DataFrame:
    """DQ2: (entity, n_ood, features) whose least or largest value lies outside the reference range."""
    wide = df.groupBy(entity).agg(*[F.min(finite(c)).alias(f"lo_{c}") for c in columns], *[F.max(finite(c)).alias(f"hi_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c in columns])
    long = wide.select(entity, F.inline(rows)).join(F.broadcast(ranges), "feature")  # one row a column
    out = F.when((F.col("lo") < F.col("low")) | (F.col("hi") > F.col("high")), F.col("feature"))
    return long.groupBy(entity).agg(F.count(out).alias("n_ood"), F.concat_ws(",", F.array_sort(F.collect_list(out))).alias("ood"))


#: Fixed values of the surveyed quality policy: penalties, limits and cut-offs.
PENALTIES = {"short": 0.15, "duplicates": 0.25, "ordering": 0.20, "gaps": 0.15, "missing": 0.25, "implausible": 0.20, "ood": 0.05, "ood_most": 0.25}
GOOD_ROWS, MAX_GAP, MISSING_GOOD, MISSING_MOST = 40, 25, 0.05, 0.30
BOUNDS = {"capacity_ah": (0.0, 4.0), "voltage_mean_v": (0.0, 5.0), "temperature_max_c": (-40.0, 100.0)}
FLEET_PARTS = {"poor": (0.10, 0.25), "insufficient": (0.10, 0.25), "missing": (0.10, 0.30)}
CHECKS = ("history", "duplicates", "ordering", "gaps", "missing", "implausible", "ood")


def quality_scores(
    df: DataFrame, columns: Sequence[str], ranges: DataFrame, min_rows: int = 10, good_rows: int = GOOD_ROWS, max_gap: int = MAX_GAP,
    bounds: dict[str, tuple[float, float]] | None = None, arrival: str | None = None, positive: str = "capacity_ah", entity: str = ID, order: str = ORDER,
) -> DataFrame:
    """DQ1: one minus the penalties of each check, with its class and the features that an entity lacks altogether.

    bounds: the plausible values of columns, ends included; `positive` must also exceed
    its lower end. arrival: the order in which rows came; without it the ordering check
    passes. ranges: (feature, low, high) of the reference, one row a column.
    """
    bounds = BOUNDS if bounds is None else bounds
    steps = {"_gap": F.col(order) - F.lag(order).over(history(entity, order))}
    if arrival:
        steps["_turn"] = F.col(order) - F.lag(order).over(history(entity, arrival))
    bad = F.lit(False)
    for c, (low, high) in bounds.items():
        if c in df.columns:
            bad = bad | F.coalesce((F.col(c) < low) | (F.col(c) > high) | (F.col(c) <= low if c == positive else F.lit(False)), F.lit(False))
    g = df.withColumns(steps).groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(order).alias("orders"), F.max("_gap").alias("gap"),
        (F.count_if(F.col("_turn") <= 0) if arrival else F.lit(0)).alias("turned"), F.count_if(bad).alias("implausible"),
        *[F.count(c).alias(f"_c_{c}") for c in columns], *[F.min(finite(c)).alias(f"_lo_{c}") for c in columns], *[F.max(finite(c)).alias(f"_hi_{c}") for c in columns],
    )
    absent = F.concat_ws(",", *[F.when(F.col(f"_c_{c}") == 0, F.lit(c)) for c in columns])
    g = g.withColumn("absent", absent).withColumn("missing", sum(((F.col(f"_c_{c}") == 0).cast("int") for c in columns), F.lit(0)) / len(columns))
    wide = ranges.filter(F.col("feature").isin(*columns)).agg(*[F.max(F.when(F.col("feature") == c, F.col(k))).alias(f"_{k}_{c}") for c in columns for k in ("low", "high")])
    g = g.join(F.broadcast(wide), F.lit(True), "cross")  # one row
    out = [(F.col(f"_lo_{c}") < F.col(f"_low_{c}")) | (F.col(f"_hi_{c}") > F.col(f"_high_{c}")) for c in columns]
    g = g.withColumn("n_ood", sum((F.coalesce(x, F.lit(False)).cast("int") for x in out), F.lit(0)))
    # Decimals: a sum of penalties may lie on the least score of a class, which the last bit of a double must not decide.
    exact = lambda x: F.lit(Decimal(str(x))).cast("decimal(18, 6)")
    p, zero, most = {k: exact(x) for k, x in PENALTIES.items()}, exact(0), exact(1)
    penalties = {
        "history": F.when(F.col("n") < min_rows, most).when(F.col("n") < good_rows, p["short"]).otherwise(zero),
        "duplicates": F.when(F.col("orders") < F.col("n"), p["duplicates"]).otherwise(zero),
        "ordering": F.when(F.col("turned") > 0, p["ordering"]).otherwise(zero),
        "gaps": F.when(F.col("gap") > max_gap, p["gaps"]).otherwise(zero),
        "missing": F.when(F.col("missing") > MISSING_MOST, most).when(F.col("missing") > MISSING_GOOD, p["missing"]).otherwise(zero),
        "implausible": F.when(F.col("implausible") > 0, p["implausible"]).otherwise(zero),
        "ood": F.least((p["ood"] * F.col("n_ood")).cast("decimal(18, 6)"), p["ood_most"]),
    }
    g = g.withColumns({f"p_{k}": v for k, v in penalties.items()})
    g = g.withColumn("score", F.greatest((1 - sum((F.col(f"p_{k}") for k in penalties), zero)).cast("double"), F.lit(0.0)))
    insufficient = (F.col("n") < min_rows) | (F.col("missing") > MISSING_MOST)
    # A short history is a warning, not a failed check.
    failed = F.concat_ws(",", *[F.when(F.col("n") < min_rows if k == "history" else F.col(f"p_{k}") > 0, F.lit(k)) for k in penalties])
    return g.select(
        entity, "n", "n_ood", "missing", "absent", "score",
        F.when(insufficient, "insufficient").otherwise(quality_class()).alias("quality_class"), failed.alias("failed_checks"),
    )


def fleet_quality(scores: DataFrame, failed: int = 0) -> DataFrame:
    """DQ3: class counts, mean score, poor and insufficient parts, mean part of absent features, and status.

    failed: entities that could not be processed; they are poor and count in the fleet.
    The status is the worst of three ladders.
    """
    poor = F.col("quality_class").isin("poor", "insufficient", "failed")
    out = scores.agg(
        (F.count(F.lit(1)) + failed).alias("n"), F.avg("score").alias("mean_score"), (F.count_if(poor) + failed).alias("_poor"),
        F.count_if(F.col("quality_class") == "insufficient").alias("_insufficient"), F.avg("missing").alias("mean_missing"),
        *[F.count_if(F.col("quality_class") == c).alias(f"n_{c}") for c in ("good", "acceptable", "poor", "insufficient")],
    )
    parts = {"poor": F.try_divide("_poor", "n"), "insufficient": F.try_divide("_insufficient", "n"), "missing": F.col("mean_missing")}
    over = lambda i: F.coalesce(F.greatest(*[(x >= FLEET_PARTS[k][i]).cast("int") for k, x in parts.items()]), F.lit(0)) == 1
    status = ladder((F.col("n") == 0, "unknown"), (over(1), "critical"), (over(0), "warning"), otherwise="ok")
    return out.withColumns({"poor_fraction": parts["poor"], "insufficient_fraction": parts["insufficient"], "status": status}).drop("_poor", "_insufficient")


def failure_rates(scores: DataFrame, checks: Sequence[str] = CHECKS) -> DataFrame:
    """DQ3: (check_name, rate)."""
    wide = scores.agg(*[F.avg(F.array_contains(F.split("failed_checks", ","), c).cast("int")).alias(c) for c in checks])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("rate")) for c in checks])))


def absence_rates(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """DQ3: (feature, rate): the part of entities that lack a required feature altogether."""
    wide = scores.agg(*[F.avg(F.array_contains(F.split("absent", ","), c).cast("int")).alias(c) for c in columns])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("rate")) for c in columns])))


def quality_detail(records: DataFrame, scores: DataFrame, entity: str = ID) -> DataFrame:
    """DQ4: the fleet's entities with their quality behind the verdict; entities without one stay."""
    detail = scores.select(entity, "quality_class", "score", "n", "n_ood", "missing", F.concat_ws(",", F.slice(F.split("failed_checks", ","), 1, 10)).alias("warnings"))
    return records.select(entity, "status").join(detail, entity, "left")


def latest_state(df: DataFrame, signals: Sequence[str], value: str = "capacity_ah", nominal: float = 2.0, entity: str = ID, order: str = ORDER) -> DataFrame:
    """TWN1: the newest row of each entity, its span, fade, and which signals it has."""
    last = F.max_by(F.struct(order, *signals), F.col(order)).alias("s")
    g = df.groupBy(entity).agg(last, F.min(order).alias("first_cycle"), F.count(F.lit(1)).alias("n_cycles"), F.min_by(value, order).alias("first_value"))
    have = F.concat_ws(",", *[F.when(F.col(f"s.{c}").isNotNull(), F.lit(c)) for c in signals])
    lack = F.concat_ws(",", *[F.when(F.col(f"s.{c}").isNull(), F.lit(c)) for c in signals])
    return g.select(
        entity, F.col(f"s.{order}").alias("latest_cycle"), "first_cycle", "n_cycles", *[F.col(f"s.{c}").alias(c) for c in signals],
        (F.col(f"s.{value}") / nominal).alias("measured_soh"),
        (100 * (F.col("first_value") - F.col(f"s.{value}")) / F.nullif(F.col("first_value"), F.lit(0.0))).alias("fade_pct"),
        have.alias("available"), lack.alias("missing_signals"),
    )


def gate(states: DataFrame, scores: DataFrame, first_scoreable: int = 11, entity: str = ID) -> DataFrame:
    """TWN2: status and reason: scored only with features, past the warm-up, and of sufficient quality."""
    df = states.join(scores.select(entity, "quality_class"), entity, "left")
    reason = ladder(
        (F.col("quality_class").isNull(), "no_features"), (F.col("latest_cycle") < first_scoreable, "warm_up"),
        (F.col("quality_class") == "insufficient", "quality"),
    )
    status = ladder((reason == "no_features", "failed"), (reason.isNotNull(), "insufficient_data"), otherwise="success")
    return df.select(entity, "latest_cycle", "quality_class", reason.alias("reason"), status.alias("status"))


def withhold_experimental(df: DataFrame, risk: str = "failure_risk", flag: str = "risk_is_experimental") -> DataFrame:
    """TWN3."""
    return df.withColumn(risk, F.when(~F.col(flag), F.col(risk)))


def forecast_warning(df: DataFrame, now: str = "measured_soh", forecast: str = "predicted_soh", slack: float = 0.01) -> DataFrame:
    """TWN4: a forecast above present health by more than the slack."""
    return df.withColumn("forecast_warning", F.coalesce(F.col(forecast) > F.col(now) + slack, F.lit(False)))
