"""Delayed-label performance, alerts, statuses and history tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanetrack.functions.exprs import ladder
from wanetrack.functions.quantiles import exact_quantiles
from wanetrack.operators.calibrate import ranking_quality
from wanetrack.operators.drift import DRIFTED_PARTS
from wanetrack.operators.quality import FLEET_PARTS
from wanetrack.sources.stored import first_of_key, same_key
from wanetrack.sources.tables import written

KEYS = ["battery_id", "cycle_index"]


def unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """df, which fails while it runs if two rows share a key. Keys with a null match nothing and may repeat.

    Rows are counted within their key, in the exchange that a join by the keys needs
    anyway, so the check reads and shuffles nothing twice.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    told = F.concat(F.lit(f"{what}: "), F.concat_ws(", ", *[F.concat(F.lit(f"{k} = "), F.col(k).cast("string")) for k in keys]), F.lit(" occurs "), F.col("_n").cast("string"), F.lit(" times"))
    checked = df.withColumn("_n", n).withColumn("_n", F.when((F.col("_n") > 1) & whole, F.raise_error(told).cast("long")).otherwise(F.col("_n")))
    return checked.filter(F.col("_n") > 0).drop("_n")


def attach_labels(features: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """JON1: features with the label of their key, or nulls; a key that occurs twice on either side is an error."""
    return unique(features, keys, "features").join(unique(labels, keys, "labels"), list(keys), "left")


def match_outcomes(predictions: DataFrame, outcomes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """JON2: predictions with the label that has arrived for them; a key with two labels is an error."""
    return predictions.join(unique(outcomes, keys, "outcomes"), list(keys), "inner")


def label_coverage(predictions: DataFrame, outcomes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """JON2: how much of either side finds its match; a key with two labels is an error."""
    marked = predictions.select(*keys).withColumn("p", F.lit(1)).join(unique(outcomes.select(*keys), keys, "outcomes").withColumn("o", F.lit(1)), list(keys), "full_outer")
    return marked.agg(F.count("p").alias("predictions"), F.count_if(F.col("o").isNotNull() & F.col("p").isNull()).alias("_alone"), F.count_if(F.col("p").isNotNull() & F.col("o").isNotNull()).alias("matched"),
                      F.count_distinct(F.when(F.col("p").isNotNull() & F.col("o").isNotNull(), F.struct(*keys))).alias("_met")).select(
        "predictions", (F.col("_alone") + F.col("_met")).alias("labels"), "matched", F.try_divide("matched", "predictions").alias("coverage")
    )


#: Fixed values of the surveyed performance policy: (warning, degraded), floors and tolerances.
LEAST_LABELS, MAE_LEVELS, SOH_LEVELS, BRIER_LEVELS = 20, (5.0, 15.0), (0.03, 0.06), (0.15, 0.25)
PR_FLOOR, COVERAGE_SLACK = 0.50, 0.05


def performance_report(
    predictions: DataFrame, outcomes: DataFrame, version: str | None = None, nominal: float = 0.9, min_labels: int = LEAST_LABELS,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """PRF1: one row: what has been joined, metrics, the thresholds that are crossed, and status.

    Rows of `version` alone are scored if it has enough labels, else all (`scope`). Each
    metric needs enough rows of its own; without enough labels at all none is published.
    Columns: y_pred, soh, probability, bounds; observed_rul, observed_soh, eol_within_horizon.
    """
    used = ["model_version", "y_pred", "soh", "probability", "rul_lower_bound", "rul_upper_bound", "observed_rul", "observed_soh", "eol_within_horizon"]
    every = written(match_outcomes(predictions, outcomes, keys).select(*used), "matched")  # read three times below
    total = predictions.agg(F.count(F.lit(1)).alias("n_predictions"))
    joined = every.agg(F.count(F.lit(1)).alias("n_joined"), F.count_if(F.col("model_version") == version).alias("n_version"))
    counts = total.join(joined, F.lit(True), "cross")  # one row each
    counts = counts.withColumn("scope", F.when(F.col("n_version") >= min_labels, F.lit(version)).otherwise("all"))
    scope = F.broadcast(counts.select("scope", (F.col("n_joined") >= min_labels).alias("enough")))
    rows = every.join(scope, F.lit(True), "cross").filter("enough AND (scope = 'all' OR model_version = scope)")  # one row
    err, soh = F.col("y_pred") - F.col("observed_rul"), F.col("soh") - F.col("observed_soh")
    ends = F.col("rul_lower_bound").isNotNull() & F.col("rul_upper_bound").isNotNull() & err.isNotNull()
    inside = F.col("observed_rul").between(F.col("rul_lower_bound"), F.col("rul_upper_bound")).cast("int")
    y, p = F.col("eol_within_horizon").cast("double"), F.col("probability")
    both = y.isNotNull() & p.isNotNull()
    m = rows.agg(
        F.count(err).alias("n_rul"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(err).alias("bias"),
        F.avg(F.when(ends, inside)).alias("interval_coverage"), F.count(soh).alias("n_soh"), F.avg(F.abs(soh)).alias("soh_mae"),
        F.count_if(both).alias("n_risk"), F.avg(F.when(both, (p - y) * (p - y))).alias("brier"), F.min(F.when(both, y)).alias("_y0"), F.max(F.when(both, y)).alias("_y1"),
    )
    risk = ranking_quality(rows.filter(both).select(p.alias("probability"), F.col("eol_within_horizon").cast("int").alias("label"))).select(F.col("average_precision").alias("pr_auc"))
    out = counts.join(m, F.lit(True), "cross").join(risk, F.lit(True), "cross")  # one row each
    two = (F.col("n_risk") >= min_labels) & (F.col("_y0") < F.col("_y1"))
    shown = {k: F.col("n_rul") >= min_labels for k in ("mae", "rmse", "bias", "interval_coverage")} | {"soh_mae": F.col("n_soh") >= min_labels, "brier": two, "pr_auc": two}
    out = out.withColumns({k: F.when(c, F.col(k)) for k, c in shown.items()})
    level = lambda k, c, at: F.when(F.col(c) >= at[1], f"{k}_degraded").when(F.col(c) >= at[0], f"{k}_warning")
    breaches = F.concat_ws(
        ",", level("life", "mae", MAE_LEVELS), F.when(F.col("interval_coverage") < nominal - COVERAGE_SLACK, "coverage_warning"),
        level("health", "soh_mae", SOH_LEVELS), level("risk", "brier", BRIER_LEVELS), F.when(F.col("pr_auc") < PR_FLOOR, "ranking_degraded"),
    )
    out = out.withColumn("breaches", breaches).withColumn("label_coverage", F.coalesce(F.try_divide("n_joined", "n_predictions"), F.lit(0.0)))
    status = ladder(
        (F.col("n_joined") == 0, "no_labels"), (F.col("n_joined") < min_labels, "insufficient_labels"), (F.col("breaches").contains("degraded"), "degraded"),
        (F.col("breaches") != "", "warning"), otherwise="healthy",
    )
    return out.withColumn("status", status).select("status", "scope", "n_predictions", "n_joined", "label_coverage", "n_rul", *shown, "breaches")


def error_by_life(matched: DataFrame, edges: Sequence[float] = (0, 20, 50, 100)) -> DataFrame:
    """PRF2: mean error by band of the true life; empty bands stay, negative truths have none."""
    y, a = F.col("observed_rul"), F.abs(F.col("y_pred") - F.col("observed_rul"))
    cells = []
    for i, lo in enumerate(edges):
        inside = (y >= lo) & (y < edges[i + 1] if i + 1 < len(edges) else F.lit(True)) & a.isNotNull()
        cells.append((i, float(lo), F.count_if(inside), F.avg(F.when(inside, a))))
    wide = matched.agg(*[x.alias(f"{k}{i}") for i, _, n, m in cells for k, x in (("n", n), ("m", m))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(i).alias("band"), F.lit(lo).alias("low"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean_error")) for i, lo, _, _ in cells])))


def issued_coverage(matched: DataFrame) -> DataFrame:
    """PRF3: how often issued intervals held the truth, and their width."""
    y = F.col("observed_rul")
    return matched.filter("rul_lower_bound is not null and rul_upper_bound is not null").agg(
        F.count(F.lit(1)).alias("n"), F.avg(y.between(F.col("rul_lower_bound"), F.col("rul_upper_bound")).cast("int")).alias("coverage"),
        F.avg(F.col("rul_upper_bound") - F.col("rul_lower_bound")).alias("width"),
    )


def label_delay(matched: DataFrame) -> DataFrame:
    """PRF4."""
    d = F.col("observed_at_cycle") - F.col("cycle_index")
    mid = exact_quantiles(matched.select(d.alias("d")), ["d"], (0.5,)).select(F.col("quantiles")[0].alias("median"))
    rest = matched.agg(F.avg(d).alias("mean"), F.min(d).alias("least"), F.max(d).alias("most"))
    return F.broadcast(mid).join(rest, F.lit(True), "cross")  # one row each


def alert_id(*parts: Column) -> Column:
    """ALR2: the same facts give the same id."""
    return F.concat(F.lit("alert-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


#: Fixed value of the surveyed alert policy: critical entities that raise an alert.
CRITICAL_ENTITIES = 5
_ACTS = {
    "data_quality": "check the telemetry", "scoring_failures": "read the errors of each entity", "critical_entities": "review each critical entity",
    "feature_drift": "compare inputs and population with the reference", "prediction_drift": "compare with feature drift and age",
    "performance": "review the crossed thresholds", "model_unavailable": "restore the model before routing to it",
}


def fleet_alerts(
    fleet: str, batch: str, quality: DataFrame | None = None, priorities: DataFrame | None = None, feature_drift: DataFrame | None = None,
    prediction_drift: DataFrame | None = None, performance: DataFrame | None = None, readiness: DataFrame | None = None,
    muted: Sequence[str] = (), cap: int = 200,
) -> DataFrame:
    """ALR1: alerts of ten types: (alert_type, severity, evidence, observed, threshold, action, alert_id).

    Each input is optional and has one row but `priorities` (status and priority an
    entity): quality of fleet_quality(), feature_drift of fleet_drift(), prediction_drift
    (status, n_drifted), performance of performance_report(), readiness (ready, errors).
    Critical alerts come first; the cap is the report's own limit.
    """
    status, none = F.col("status"), F.lit(None).cast("double")
    found = []

    def add(df: DataFrame, kind: str, name: Column, severity: Column, evidence: Column, observed: Column, threshold: Column, key: str) -> None:
        row = df.select(
            name.alias("alert_type"), severity.alias("severity"), evidence.cast("string").alias("evidence"), observed.cast("double").alias("observed"),
            threshold.cast("double").alias("threshold"), F.lit(_ACTS[kind]).alias("action"), F.lit(key).alias("_key"),
        )
        found.append(row.filter("alert_type IS NOT NULL AND severity IS NOT NULL"))

    graded = F.when(status.isin("warning", "critical"), status)
    named = lambda kind: F.concat(F.lit(f"{kind}_"), graded)
    limit = lambda pair: F.when(status == "critical", pair[1]).when(status == "warning", pair[0])
    if quality is not None:
        told = F.format_string("%d good, %d acceptable, %d poor, %d insufficient", "n_good", "n_acceptable", "n_poor", "n_insufficient")
        add(quality, "data_quality", named("data_quality"), graded, told, F.col("poor_fraction"), limit(FLEET_PARTS["poor"]), "quality")
    if priorities is not None:
        n = priorities.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(status == "failed").alias("failed"), F.count_if(F.col("priority") == "P0").alias("critical")
        )
        severity = F.when(F.col("failed") > F.col("n") / 2, "critical").when(F.col("failed") > 0, "warning")
        add(n, "scoring_failures", F.lit("scoring_failures"), severity, F.format_string("%d of %d entities failed", "failed", "n"), F.col("failed"), none, "failures")
        severity = F.when(F.col("critical") >= CRITICAL_ENTITIES, "warning")
        add(n, "critical_entities", F.lit("critical_entities"), severity, F.format_string("%d entities are P0", "critical"), F.col("critical"), F.lit(CRITICAL_ENTITIES), "critical_count")
    if feature_drift is not None:
        told = F.format_string("%d of %d features drifted", "n_drifted", "n")
        add(feature_drift, "feature_drift", named("feature_drift"), graded, told, F.col("fraction"), limit(DRIFTED_PARTS), "feature_drift")
    if prediction_drift is not None:
        told = F.format_string("%d outputs drifted", "n_drifted")
        add(prediction_drift, "prediction_drift", F.lit("prediction_drift"), graded, told, F.col("n_drifted"), none, "prediction_drift")
    if performance is not None:
        severity = F.when(status == "degraded", "critical").when(status == "warning", "warning")
        add(performance, "performance", F.concat(F.lit("performance_"), F.when(severity.isNotNull(), status)), severity, F.col("breaches"), none, none, "performance")
    if readiness is not None:
        add(readiness, "model_unavailable", F.lit("model_unavailable"), F.when(~F.col("ready"), "critical"), F.col("errors"), none, none, "readiness")
    if not found:
        raise ValueError("no input to watch")
    out = reduce(DataFrame.unionByName, found).filter(~F.col("alert_type").isin(*muted) if muted else F.lit(True))
    ident = alert_id(F.col("alert_type"), F.lit(fleet), F.lit(batch), F.col("_key"))
    return out.withColumn("alert_id", ident).drop("_key").orderBy("severity", "alert_id").limit(cap)


RANKS = {"ok": 0, "unknown": 1, "warning": 2, "critical": 3}


def worst_status(df: DataFrame, c: str = "status") -> DataFrame:
    """MON1."""
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[F.col(c)]
    return df.agg(F.coalesce(F.max_by(c, rank), F.lit("unknown")).alias("status"))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """MON2: an order-free checksum of a batch's content."""
    h = F.xxhash64(*columns)
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("total"))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """MON3."""
    g = alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("alert_type"))).alias("types"))
    return g.withColumn("total", F.sum("n").over(Window.partitionBy()))


# --- history tables ------------------------------------------------------------------


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """HIS1: the newest row a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def listing(df: DataFrame, where: Column, order: Sequence[Column], limit: int) -> DataFrame:
    """HIS2: filtered, newest first, a report of `limit` rows."""
    return df.filter(where).orderBy(*order).limit(limit)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], tie: Sequence[Column] = ()) -> DataFrame:
    """HIS3: rows of a key already there stay as they are; among new ones the first by `tie`, then by value. Null keys equal each other."""
    rows = first_of_key(new, keys, tie)
    held = old.select(*keys)
    return old.unionByName(rows.join(held, same_key(rows, held, keys), "left_anti"))


def insert_or_replace(old: DataFrame, new: DataFrame, keys: Sequence[str], tie: Sequence[Column]) -> DataFrame:
    """HIS4: the new row of a key wins; among new ones the first by `tie`, then by value."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_of_key(both, keys, [F.desc("_new"), *tie]).drop("_new")


def acknowledge(df: DataFrame, where: Column) -> DataFrame:
    """HIS5."""
    return df.withColumn("acknowledged", F.col("acknowledged") | F.coalesce(where, F.lit(False)))


def prune(df: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    """HIS6: rows at or after the cutoff."""
    return df.filter(F.col(ts) >= cutoff)


def prediction_records(records: DataFrame, snapshot: str) -> DataFrame:
    """HIS7: the evaluated rows of a snapshot as prediction records."""
    ok = records.filter("status = 'success' and predicted_rul is not null")
    return ok.select(F.concat_ws(":", F.lit(snapshot), "battery_id", "latest_cycle").alias("prediction_id"), "battery_id", F.col("latest_cycle").alias("cycle_index"), "predicted_rul", "rul_lower_bound", "rul_upper_bound")
