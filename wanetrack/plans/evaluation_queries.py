"""Queries for preprocessing, joins, metrics, calibration, conformal intervals and models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wanetrack.operators import calibrate as K
from wanetrack.operators import conformal as U
from wanetrack.operators import health as H
from wanetrack.operators import isotonic as I
from wanetrack.operators import metrics as M
from wanetrack.operators import models as X
from wanetrack.operators import monitoring as N
from wanetrack.operators import preprocess as P
from wanetrack.operators import splits as S
from wanetrack.plans.book import query
from wanetrack.plans.fixtures import fixture, table
from wanetrack.sources.tables import written

COLS = ["capacity_ah", "internal_resistance_ohm", "temperature_max_c", "voltage_min_v"]


def cycles(s, d):
    return fixture(s, d, "cycles")


def preds(s, d):
    return fixture(s, d, "predictions")


def each(template: str, columns=COLS) -> str:
    return " union all ".join(template.format(c=c) for c in columns)


# --- preprocessing -------------------------------------------------------------------


@query("pre1_fallback", each("select '{c}' as feature, quantile_cont({c}, 0.5) as fallback from cycles"), "cycles", "fallback")
def _(s, d):
    return P.fallback_values(cycles(s, d), COLS)


@query("pre2_variance", each("select '{c}' as feature, var_samp({c}) as variance, var_samp({c}) > 0.01 as kept from cycles"), "cycles", "variance")
def _(s, d):
    return P.variance_filter(cycles(s, d), COLS, 0.01)


@query("pre3_correlation_prune", """
select * from (values ('capacity_ah', false), ('internal_resistance_ohm', false), ('temperature_max_c', (select abs(corr(temperature_max_c, voltage_min_v)) > 0.98 from cycles)), ('voltage_min_v', false)) t(feature, dropped)""", "cycles")
def _(s, d):
    return P.correlation_prune(cycles(s, d), COLS)


@query("pre4_top_f", "select feature, f, row_number() over (order by f desc nulls last, feature) as rank from (" + each(
    "select '{c}' as feature, corr({c}, n_cycles - cycle_index) ** 2 * (regr_count({c}, n_cycles - cycle_index) - 2) / (1 - corr({c}, n_cycles - cycle_index) ** 2) as f from cycles"
) + ") qualify rank <= 2", "cycles", "f", digits=3)
def _(s, d):
    return P.top_by_f(cycles(s, d).withColumn("rul", F.col("n_cycles") - F.col("cycle_index")), COLS, "rul", 2)


_MI = each("select '{c}' as feature, {c} as v, n_cycles - cycle_index as l from cycles where {c} is not null")


@query("pre4_mutual_information", f"""
select feature, sum(n / nn * ln(n * nn / (nx * ny))) as mi from (
  select *, sum(n) over (partition by feature, x) as nx, sum(n) over (partition by feature, y) as ny, sum(n) over (partition by feature) as nn from (
    select feature, x, y, cast(count(*) as double) as n from (
      select feature, least(floor((v - min(v) over w) * 10 / (max(v) over w - min(v) over w)), 9) as x, least(floor((l - min(l) over w) * 10 / cast(max(l) over w - min(l) over w as double)), 9) as y
      from ({_MI}) window w as (partition by feature)) group by 1, 2, 3)) group by 1""", "cycles", "mi")
def _(s, d):
    return P.mutual_information(cycles(s, d).withColumn("rul", (F.col("n_cycles") - F.col("cycle_index")).cast("double")), COLS, "rul")


@query("pre4_tree_importance")
def _(s, d):
    return P.tree_importance(cycles(s, d).withColumn("rul", (F.col("n_cycles") - F.col("cycle_index")).cast("double")), COLS, "rul")


_ROBUST = each("select '{c}' as feature, quantile_cont({c}, 0.5) as center, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) as scale from cycles")


@query("pre5_robust_scaler", _ROBUST, "cycles", "center scale")
def _(s, d):
    return P.scaler(cycles(s, d), COLS)


@query("pre5_standard_scaler", each("select '{c}' as feature, avg({c}) as center, stddev_pop({c}) as scale from cycles"), "cycles", "center scale")
def _(s, d):
    return P.scaler(cycles(s, d), COLS, "standard")


@query("pre5_minmax_scaler", each("select '{c}' as feature, min({c}) as center, max({c}) - min({c}) as scale from cycles"), "cycles", "center scale")
def _(s, d):
    return P.scaler(cycles(s, d), COLS, "minmax")


@query("pre5_inverse", "select battery_id, cycle_index, " + ", ".join(f"coalesce({c}, (select quantile_cont({c}, 0.5) from cycles)) as {c}" for c in COLS) + " from cycles", "cycles", " ".join(COLS))
def _(s, d):
    c = cycles(s, d)
    scale = P.scaler(c, COLS)
    scaled = P.transform(c, P.fallback_values(c, COLS), scale, COLS, ["battery_id", "cycle_index"])
    return P.inverse(scaled, scale, COLS, ["battery_id", "cycle_index"])


@query("pre6_transform", "select battery_id, cycle_index, " + ", ".join(
    f"(coalesce({c}, (select quantile_cont({c}, 0.5) from cycles)) - (select quantile_cont({c}, 0.5) from cycles)) / (select quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) from cycles) as {c}" for c in COLS
) + " from cycles", "cycles", " ".join(COLS))
def _(s, d):
    c = cycles(s, d)
    return P.transform(c, P.fallback_values(c, COLS), P.scaler(c, COLS), COLS, ["battery_id", "cycle_index"])


@query("pre7_reference_ranges", each("select '{c}' as feature, min({c}) as low, max({c}) as high from cycles"), "cycles", "low high")
def _(s, d):
    return P.reference_ranges(cycles(s, d), COLS)


# --- joins ---------------------------------------------------------------------------


@query("jon1_attach_labels", "select c.battery_id, c.cycle_index, c.capacity_ah, o.observed_rul from cycles c left join outcomes o using (battery_id, cycle_index)", "cycles outcomes", "capacity_ah observed_rul")
def _(s, d):
    o = fixture(s, d, "outcomes").select("battery_id", "cycle_index", "observed_rul")
    return N.attach_labels(cycles(s, d), o).select("battery_id", "cycle_index", "capacity_ah", "observed_rul")


@query("jon2_match_outcomes", "select prediction_id, y_pred, observed_rul from predictions join outcomes using (battery_id, cycle_index)", "predictions outcomes", "y_pred observed_rul")
def _(s, d):
    return N.match_outcomes(preds(s, d), fixture(s, d, "outcomes")).select("prediction_id", "y_pred", "observed_rul")


@query("jon2_label_coverage", """
select (select count(*) from predictions) as predictions, (select count(*) from outcomes) as labels, count(*) as matched,
  count(*) / (select count(*) from predictions) as coverage from predictions join outcomes using (battery_id, cycle_index)""", "predictions outcomes", "coverage")
def _(s, d):
    return N.label_coverage(preds(s, d), fixture(s, d, "outcomes"))


@query("jon3_persistence", """
select a.battery_id, a.cycle_index, a.soh, b.soh as soh_before from predictions a left join predictions b on a.battery_id = b.battery_id and b.cycle_index = a.cycle_index - 5""", "predictions", "soh soh_before")
def _(s, d):
    p = preds(s, d).select("battery_id", "cycle_index", "soh")
    b = p.select("battery_id", (F.col("cycle_index") + 5).alias("cycle_index"), F.col("soh").alias("soh_before"))
    return p.join(b, ["battery_id", "cycle_index"], "left")


@query("jon4_entity_scalar", "select battery_id, cycle_index, capacity_ah / (select max(capacity_ah) from cycles x where x.battery_id = c.battery_id) as part from cycles c", "cycles", "part")
def _(s, d):
    from wanetrack.functions.exprs import whole

    return cycles(s, d).select("battery_id", "cycle_index", (F.col("capacity_ah") / F.max("capacity_ah").over(whole("battery_id"))).alias("part"))


_TWO = "select battery_id, cycle_index, soh, y_true, y_pred + o as y_pred, m as model, cycle_index % 4 as fold from predictions, (values ('a', 0.0::double, 6), ('b', 2.5::double, 12)) t(m, o, f) where cycle_index >= f and y_pred is not null"


def two_models(s, d):
    t = F.explode(F.expr("array(struct('a' as m, 0.0D as o, 6 as f), struct('b' as m, 2.5D as o, 12 as f))"))
    p = preds(s, d).withColumn("t", t).filter("cycle_index >= t.f and y_pred is not null")
    return p.select("battery_id", "cycle_index", "soh", "y_true", (F.col("y_pred") + F.col("t.o")).alias("y_pred"), F.col("t.m").alias("model"), (F.col("cycle_index") % 4).alias("fold"))


@query("jon5_common_rows", "select model, count(*) as n from two where (battery_id, cycle_index) in (select battery_id, cycle_index from two group by 1, 2 having count(distinct model) = 2) group by 1", "predictions", two=_TWO)
def _(s, d):
    return M.common_rows(two_models(s, d), ["battery_id", "cycle_index"]).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("jon6_append_failures", """
select battery_id, status from records where status = 'success' union all
select battery_id, 'failed' from records where status <> 'success'""", "records")
def _(s, d):
    r = fixture(s, d, "records").select("battery_id", "status")
    ok = r.filter("status = 'success'")
    return ok.unionByName(r.join(ok.select("battery_id"), "battery_id", "left_anti").withColumn("status", F.lit("failed")))


_ANALOGUES = """
with ref as (select soh, y_true as rul from predictions where cast(battery_id as int) % 2 = 0),
ranked as (select *, row_number() over (order by soh, rul) - 1 as pos from ref),
q as (select battery_id, cycle_index, coalesce(pl, 0) as pl, (select count(*) from ref) as n from (
  select *, sum(k) over (order by soh, k rows between unbounded preceding and 1 preceding) as pl from (
    select battery_id, cycle_index, soh, 0 as k from predictions where cast(battery_id as int) % 2 = 1 union all select null, null, soh, 1 from ref)) where k = 0)
select battery_id, cycle_index, quantile_cont(rul, 0.5) as y_pred, count(*) as n_analogues from (select *, greatest(least(pl - 12, n - 25), 0) + i as pos from q, range(25) t(i)) join ranked using (pos) group by 1, 2"""


@query("jon7_nearest_analogues", _ANALOGUES, "predictions", "y_pred")
@query("jon7_nearest_analogues_every_row", _ANALOGUES, "predictions", "y_pred")
def _(s, d):
    p = preds(s, d)
    ref = p.filter("cast(battery_id as int) % 2 = 0").select("soh", F.col("y_true").alias("rul"))
    return X.nearest_analogues(p.filter("cast(battery_id as int) % 2 = 1"), ref, keys=["battery_id", "cycle_index"])


@query("jon8_asof_last_known", """
select p.battery_id, p.cycle_index, (select max(o.cycle_index) from outcomes o where o.battery_id = p.battery_id and o.cycle_index <= p.cycle_index) as labelled_at from predictions p""", "predictions outcomes")
def _(s, d):
    from wanetrack.functions.exprs import BEFORE, history

    o = fixture(s, d, "outcomes").select("battery_id", "cycle_index", F.col("cycle_index").alias("at"))
    both = preds(s, d).select("battery_id", "cycle_index").join(o, ["battery_id", "cycle_index"], "left")
    return both.select("battery_id", "cycle_index", F.last("at", True).over(history("battery_id", "cycle_index").rowsBetween(BEFORE, 0)).alias("labelled_at"))


# --- metrics -------------------------------------------------------------------------

_BLOCK = """count(y_true) as n, avg(abs(y_pred - y_true)) as mae, sqrt(avg((y_pred - y_true) ** 2)) as rmse, avg((y_pred - y_true) ** 2) as mse, quantile_cont(abs(y_pred - y_true), 0.5) as median_ae,
  max(abs(y_pred - y_true)) as max_error, 100 * avg(abs(y_pred - y_true) / greatest(abs(y_true), 1.0)) as mape,
  100 * avg(coalesce(2 * abs(y_pred - y_true) / nullif(abs(y_true) + abs(y_pred), 0), 0)) as smape,
  1 - sum((y_pred - y_true) ** 2) / nullif(var_pop(y_true) * count(y_true), 0) as r2, avg(y_pred - y_true) as bias, stddev_pop(y_pred - y_true) as error_std,
  avg(cast(abs(y_pred - y_true) <= 0.2 * greatest(y_true, 1.0) as int)) as alpha_lambda, avg(cast(abs(y_pred - y_true) <= 10 as int)) as within_10, avg(cast(abs(y_pred - y_true) <= 25 as int)) as within_25"""
_DBL = "mae rmse mse median_ae max_error mape smape r2 bias error_std alpha_lambda within_10 within_25"


@query("met1_regression_metrics", f"select {_BLOCK} from predictions where y_pred is not null", "predictions", _DBL)
def _(s, d):
    return M.regression_metrics(preds(s, d))


@query("met2_entity_metrics", f"select battery_id, {_BLOCK} from predictions where y_pred is not null group by 1", "predictions", _DBL)
def entity_metrics(s, d):
    return M.regression_metrics(preds(s, d), ["battery_id"])


_HOR = """select battery_id, max(case when a = 1 then y_true end) as horizon from (select *, min(cast(abs(y_pred - y_true) <= 0.2 * greatest(y_true, 1.0) as int)) over
  (partition by battery_id order by y_true desc rows between current row and unbounded following) as a from predictions where y_pred is not null) group by 1"""


@query("met3_prognostic_horizon", _HOR, "predictions", "horizon")
def _(s, d):
    return M.prognostic_horizon(preds(s, d))


@query("met4_mean_horizon", f"select avg(horizon) as mean_horizon, count(horizon) as n_with_horizon, count(*) as n_entities from ({_HOR})", "predictions", "mean_horizon")
def _(s, d):
    return M.mean_horizon(M.prognostic_horizon(preds(s, d)))


@query("met5_residual_summary", """
select quantile_cont(r, 0.05) as q05, quantile_cont(r, 0.25) as q25, quantile_cont(r, 0.5) as q50, quantile_cont(r, 0.75) as q75, quantile_cont(r, 0.95) as q95, avg(r) as mean, stddev_pop(r) as std,
  skewness(r) as skew, kurtosis(r) as kurtosis, corr(r, y_true) as corr_truth from (select y_pred - y_true as r, y_true from predictions where y_pred is not null)""", "predictions",
       "q05 q25 q50 q75 q95 mean std skew kurtosis corr_truth")
def _(s, d):
    return M.residual_summary(preds(s, d))


@query("met6_bootstrap")
def _(s, d):
    return M.bootstrap_mae(preds(s, d))


@query("met7_skill", """
select model, count(*) as n, avg(abs(y_pred - y_true)) as mae, avg(abs(rul_upper_bound - y_true)) as baseline_mae,
  (avg(abs(rul_upper_bound - y_true)) - avg(abs(y_pred - y_true))) / avg(abs(rul_upper_bound - y_true)) as skill from predictions where y_pred is not null group by 1""", "predictions", "mae baseline_mae skill")
def _(s, d):
    return M.skill(preds(s, d), "rul_upper_bound", ["model"])


@query("met8_compare_models", f"select model, mae, rank from (select *, row_number() over (order by mae nulls last, model) as rank from (select model, {_BLOCK} from predictions where y_pred is not null group by 1))", "predictions", "mae")
def _(s, d):
    return M.compare_models(preds(s, d)).select("model", "mae", "rank")


@query("met9_compare_common", """
select model, mae, row_number() over (order by mae, model) as rank from (select model, avg(abs(y_pred - y_true)) as mae from two
where (battery_id, cycle_index) in (select battery_id, cycle_index from two group by 1, 2 having count(distinct model) = 2) group by 1)""", "predictions", "mae", two=_TWO)
def _(s, d):
    return M.compare_models(M.common_rows(two_models(s, d), ["battery_id", "cycle_index"])).select("model", "mae", "rank")


@query("met10_pooled_folds", """
select model, sum(s) / sum(n) as mae, sum(n) / sum(n) as coverage, stddev_samp(m) as fold_std, arg_max(fold, {'a': m, 'b': fold}) as worst_fold, count(*) as folds from (
  select model, fold, sum(abs(y_pred - y_true)) as s, count(*) as n, avg(abs(y_pred - y_true)) as m from two group by 1, 2) group by 1""", "predictions", "mae coverage fold_std", two=_TWO)
def _(s, d):
    return M.pooled_folds(two_models(s, d))


_BAND = "case when y_true < 10 then 0 when y_true < 25 then 1 when y_true < 50 then 2 when y_true < 100 then 3 else 4 end"


@query("met11_error_bands", f"""
select band, [0.0, 10.0, 25.0, 50.0, 100.0][band + 1]::double as low, count(*) as n, avg(abs(r)) as mae, avg(r) as bias, quantile_cont(abs(r), 0.9) as p90
from (select {_BAND} as band, y_pred - y_true as r from predictions where y_pred is not null and y_true >= 0) group by 1""", "predictions", "low mae bias p90")
def _(s, d):
    return M.error_bands(preds(s, d))


_WORST = "select *, abs(y_pred - y_true) as e, (select quantile_cont(abs(y_pred - y_true), 0.9) from predictions) as cut from predictions where y_pred is not null"


@query("met11_error_analysis", f"select max(cut) as threshold, count(*) filter (where e >= cut) as n_worst, avg(y_true) filter (where e >= cut) as worst_mean_true, avg(y_true) as overall_mean_true from ({_WORST})", "predictions", "threshold worst_mean_true overall_mean_true")
def _(s, d):
    return M.error_analysis(preds(s, d))


@query("met11_worst_entities", f"select battery_id, count(*) as n from ({_WORST}) where e >= cut group by 1", "predictions")
def _(s, d):
    return M.worst_entities(preds(s, d))


@query("met11_worst_rows", """
select prediction_id, abs(y_pred - y_true) as abs_error from predictions where abs(y_pred - y_true) >= (select quantile_cont(abs(y_pred - y_true), 0.9) from predictions) order by 2 desc, 1 limit 15""", "predictions", "abs_error")
def _(s, d):
    return M.worst_rows(preds(s, d)).select("prediction_id", "abs_error")


@query("met12_latest_predictions", """
select battery_id, max(cycle_index) as last_order, max(case when y_pred is not null then cycle_index end) as scored_order, arg_max(y_pred, cycle_index) filter (where y_pred is not null) as prediction,
  avg(abs(y_pred - y_true)) as mae, case when count(y_pred) = 0 then 'insufficient_history' else 'scored' end as status from predictions group by 1""", "predictions", "prediction mae")
def _(s, d):
    return M.latest_predictions(preds(s, d))


@query("met13_champion", "select model, mae from (select model, avg(abs(y_pred - y_true)) as mae from predictions group by 1) order by mae, model limit 1", "predictions", "mae")
def _(s, d):
    return M.champion(M.regression_metrics(preds(s, d), ["model"])).select("model", "mae")


# --- calibration ---------------------------------------------------------------------


@query("cal1_brier", "select avg((probability - label) ** 2) as brier from predictions", "predictions", "brier")
def _(s, d):
    return K.brier(preds(s, d))


_CURVE = """select bin, count(p) as n, avg(p) as mean_predicted, avg(y) as observed from range(10) t(bin) left join (
  select probability as p, label as y, cast(""" + " + ".join(f"(case when probability >= {i / 10} then 1 else 0 end)" for i in range(1, 10)) + " as bigint) as bin from predictions) using (bin) group by 1"


@query("cal2_reliability", _CURVE, "predictions", "mean_predicted observed")
def _(s, d):
    return K.reliability(preds(s, d))


@query("cal3_ece", f"select sum(n * abs(mean_predicted - observed)) / sum(n) as ece from ({_CURVE})", "predictions", "ece")
def _(s, d):
    return K.expected_calibration_error(K.reliability(preds(s, d)))


_STEPS = """select *, sum(pos) over (order by t desc) as tp, sum(neg) over (order by t desc) as fp, sum(pos) over () as p, sum(neg) over () as n
  from (select probability as t, sum(label) as pos, sum(1 - label) as neg from predictions group by 1)"""


def _areas(score, name):
    steps = f"select *, sum(pos) over (order by t desc) as tp, sum(neg) over (order by t desc) as fp, sum(pos) over () as p, sum(neg) over () as n from (select {score} as t, sum(label) as pos, sum(1 - label) as neg from predictions group by 1)"
    return f"(select sum(neg * (tp - pos / 2)) / (max(p) * max(n)) as roc_auc{name}, sum(pos * tp / (tp + fp)) / max(p) as average_precision{name} from ({steps}))"


@query("cal4_against_order", f"""
select *, average_precision > average_precision_order as beats_order from (select count(*) as n, cast(sum(label) as bigint) as n_positive from predictions), {_areas('probability', '')}, {_areas('cycle_index', '_order')}
union all select count(*), 0, null, null, null, null, null from predictions where label = 0""", "predictions", "roc_auc average_precision roc_auc_order average_precision_order")
def _(s, d):
    p = preds(s, d)
    return K.against_order(p).union(K.against_order(p.filter("label = 0")))


@query("cal4_ranking_quality", f"""
select roc_auc, average_precision, tp, fp, fn, tn, tp / nullif(tp + fp, 0) as precision, tp / nullif(tp + fn, 0) as recall, 2 * tp / nullif(2 * tp + fp + fn, 0) as f1 from (
  select sum(neg * (tp - pos / 2)) / (max(p) * max(n)) as roc_auc, sum(pos * tp / (tp + fp)) / max(p) as average_precision from ({_STEPS})), (
  select count(*) filter (where probability >= 0.5 and label = 1) as tp, count(*) filter (where probability >= 0.5 and label = 0) as fp,
    count(*) filter (where probability < 0.5 and label = 1) as fn, count(*) filter (where probability < 0.5 and label = 0) as tn from predictions)""", "predictions",
       "roc_auc average_precision precision recall f1")
def _(s, d):
    return K.ranking_quality(preds(s, d))


@query("cal5_threshold_search", """
select t as threshold, round(v, 12) as value from (select t, 2 * tp / nullif(tp + fp + p, 0) as v from (
  select t, sum(pos) over (order by t desc) as tp, sum(neg) over (order by t desc) as fp, sum(pos) over () as p from (
    select t, sum(pos) as pos, sum(neg) as neg from (select probability as t, label as pos, 1 - label as neg from predictions union all select 0.0, 0, 0 union all select 1.0, 0, 0) group by 1)))
where v is not null order by round(v, 12) desc, t limit 1""", "predictions", "threshold value")
def _(s, d):
    return K.threshold_search(preds(s, d))


# value of a point: over all starts at or before it the largest, over all ends at or after it the smallest mean
@query("cal6_isotonic", """
with pts as (select probability as x, sum(label) as s, count(*) as n, row_number() over (order by probability) as i from predictions where cycle_index % 2 = 0 group by 1),
cum as (select *, sum(s) over (order by i) as cs, sum(n) over (order by i) as cn from pts),
spans as (select a.i as a, b.i as b, (b.cs - a.cs + a.s) / cast(b.cn - a.cn + a.n as double) as m from cum a join cum b on b.i >= a.i),
ends as (select a, b as i, min(m) over (partition by a order by b desc) as least from spans),
fitted as (select i, max(least) as v from ends group by 1),
model as (select x, v, lead(x) over (order by x) as x2, lead(v) over (order by x) as v2 from pts join fitted using (i))
select prediction_id, case when m.x is null then (select v from model order by x limit 1) when x2 is null or probability = m.x then v
    else v + (v2 - v) * (probability - m.x) / (x2 - m.x) end as calibrated
from predictions asof left join model m on probability >= m.x""", "predictions", "calibrated")
def _(s, d):
    p = preds(s, d)
    asked = p.select("prediction_id", K.PROB)  # apply writes its rows, all of each
    return I.apply_isotonic(I.fit_isotonic(p.filter("cycle_index % 2 = 0"), K.PROB, K.LABEL), asked, K.PROB).select("prediction_id", "calibrated")


@query("cal6_platt")
def _(s, d):
    m = K.fit_platt(preds(s, d))
    return s.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double")


# --- conformal intervals -------------------------------------------------------------

_SCORES = "select battery_id, max(abs(y_pred - y_true)) as score from predictions where y_pred is not null group by 1"
_Q = """select {by} score as quantile, n as n_scores from (select *, row_number() over ({part} order by score) - 1 as rn, count(*) over ({part}) as n from ({inner}))
  where rn = ceil(round(least(ceil(round((n + 1) * 0.9, 9)) / n, 1.0) * (n - 1), 9))"""


@query("unc1_conformal_quantile", _Q.format(by="", part="", inner=_SCORES), "predictions", "quantile")
def _(s, d):
    return U.conformal_quantile(U.block_scores(preds(s, d)))


_STAGE = "case when soh is null then 'unknown' when soh >= 0.9 then 'early' when soh >= 0.8 then 'mid' else 'late' end"
_BLOCKS = f"select stage, battery_id, max(abs(y_pred - y_true)) as score, count(*) as k from (select *, {_STAGE} as stage from predictions) where y_pred is not null group by 1, 2"
_SQ = f"""select stage, case when e >= 3 and k >= 20 then quantile else (select quantile from ({_Q.format(by="", part="", inner=_SCORES)})) end as quantile, not (e >= 3 and k >= 20) as fell_back
  from ({_Q.format(by="stage,", part="partition by stage", inner=_BLOCKS)}) join (select stage, count(*) as e, sum(k) as k from ({_BLOCKS}) group by 1) using (stage)"""


@query("unc2_stage_quantiles", _SQ, "predictions", "quantile")
def _(s, d):
    return U.stage_quantiles(preds(s, d))


@query("unc3_life_stage", f"select {_STAGE} as stage, count(*) as n from predictions group by 1", "predictions")
def _(s, d):
    return preds(s, d).groupBy(U.life_stage().alias("stage")).agg(F.count(F.lit(1)).alias("n"))


_APPLIED = f"select p.*, greatest(greatest(y_pred, 0) - q.quantile, 0) as lower, greatest(y_pred, 0) + q.quantile as upper from (select *, {_STAGE} as stage from predictions) p left join ({_SQ}) q using (stage)"


@query("unc4_apply_intervals", f"select prediction_id, case when y_pred is not null then lower end as lower, case when y_pred is not null then upper end as upper from ({_APPLIED})", "predictions", "lower upper")
def _(s, d):
    p = preds(s, d).filter("y_pred is not null")
    out = U.apply_intervals(preds(s, d), U.stage_quantiles(p))
    return out.select("prediction_id", F.when(F.col("y_pred").isNotNull(), F.col("lower")).alias("lower"), F.when(F.col("y_pred").isNotNull(), F.col("upper")).alias("upper"))


@query("unc5_cross_conformal", f"""
select held as battery_id, score as quantile from (select h.battery_id as held, x.score, row_number() over (partition by h.battery_id order by x.score, x.battery_id) - 1 as rn, count(*) over (partition by h.battery_id) as n
  from ({_SCORES}) h join ({_SCORES}) x on h.battery_id <> x.battery_id) where rn = ceil(round(least(ceil(round((n + 1) * 0.9, 9)) / n, 1.0) * (n - 1), 9))""", "predictions", "quantile")
def _(s, d):
    return U.cross_conformal(preds(s, d))


#: All entities but the held one, stage by stage and altogether; the oracle forms the pairs that the operator avoids.
_OTHERS = f"""with blocks as ({_BLOCKS} union all select '*', battery_id, max(abs(y_pred - y_true)), count(*) from predictions where y_pred is not null group by 2),
  held as (select distinct battery_id from predictions),
  pairs as (select h.battery_id, b.stage, b.score, sum(b.k) over w as rows, count(*) over w as n, row_number() over (partition by h.battery_id, b.stage order by b.score, b.battery_id) - 1 as rn
    from held h join blocks b on h.battery_id <> b.battery_id window w as (partition by h.battery_id, b.stage)),
  q as (select battery_id, stage, score as quantile from pairs where n >= 3 and rows >= 20 and rn = ceil(round(least(ceil(round((n + 1) * 0.9, 9)) / n, 1.0) * (n - 1), 9))),
  bounded as (select p.*, coalesce(s.quantile, a.quantile) as width, case when s.quantile is not null then 'stage' when a.quantile is not null then 'all' else 'none' end as source
    from (select *, {_STAGE} as stage from predictions) p left join q s using (battery_id, stage) left join q a on p.battery_id = a.battery_id and a.stage = '*')"""


def _thinned(s, d):
    """Predictions as they are, but the first life stage has been reached by two entities only, so that every fallback occurs."""
    p = preds(s, d)
    return p.withColumn("soh", F.when((F.col("soh") >= 0.9) & ~F.col("battery_id").isin("1", "2"), F.lit(0.85)).otherwise(F.col("soh")))


_THIN = "(select * replace (case when soh >= 0.9 and battery_id not in ('1', '2') then 0.85 else soh end as soh) from predictions)"
_UNC5 = _OTHERS + " select prediction_id, stage, case when y_pred - width is not null then greatest(y_pred - width, 0.0) end as lower, y_pred + width as upper, source from bounded"


@query("unc5_intervals", _UNC5, "predictions", "lower upper")
def _(s, d):
    return U.cross_conformal_intervals(preds(s, d)).select("prediction_id", "stage", "lower", "upper", "source")


@query("unc5_intervals_with_fallback", _UNC5.replace("from predictions", f"from {_THIN}"), "predictions", "lower upper")
def _(s, d):
    return U.cross_conformal_intervals(_thinned(s, d)).select("prediction_id", "stage", "lower", "upper", "source")


@query("unc6_worst_entity", _OTHERS + """ select 'entity' as level, battery_id as name, count(*) as n, avg(cast(y_true between greatest(y_pred - width, 0.0) and y_pred + width as int)) as coverage,
  avg(y_pred + width - greatest(y_pred - width, 0.0)) as width from bounded where y_pred is not null and width is not null group by 2 order by coverage, name limit 1""", "predictions", "coverage width")
def _(s, d):
    return U.worst_entity(U.coverage(U.cross_conformal_intervals(preds(s, d))))


@query("unc6_coverage", """
select case grouping_id(battery_id, stage) when 3 then 'all' when 1 then 'entity' else 'stage' end as level, coalesce(battery_id, stage, '') as name, count(*) as n,
  avg(cast(y_true between rul_lower_bound and rul_upper_bound as int)) as coverage, avg(rul_upper_bound - rul_lower_bound) as width
from (select *, """ + _STAGE + """ as stage from predictions) group by grouping sets ((), (battery_id), (stage))""", "predictions", "coverage width")
def _(s, d):
    return U.coverage(preds(s, d).withColumn("stage", U.life_stage()), low="rul_lower_bound", high="rul_upper_bound")


# --- models --------------------------------------------------------------------------


@query("mdl1_cohort_median", "select quantile_cont(m, 0.5) as cohort_median from (select quantile_cont(n_cycles - cycle_index, 0.5) as m from cycles group by battery_id)", "cycles", "cohort_median")
def _(s, d):
    return X.cohort_median(cycles(s, d).withColumn("rul_raw_cycles", (F.col("n_cycles") - F.col("cycle_index")).cast("double")))


_MDL2 = """select battery_id, cycle_index, n_cycles, least(greatest(case when n >= 3 and a < -1e-9 then (1.4 - b) / a - cycle_index else 40.0 end, 0.0), 120.0) as y_pred from (
  select *, regr_slope(capacity_ah, cycle_index) over w as a, regr_intercept(capacity_ah, cycle_index) over w as b, count(capacity_ah) over w as n
  from cycles window w as (partition by battery_id order by cycle_index rows between 19 preceding and current row))"""


@query("mdl2_fade_extrapolation", f"select battery_id, cycle_index, y_pred from ({_MDL2}) where cycle_index > 3", "cycles", "y_pred", digits=3)
def _(s, d):
    return X.fade_extrapolation(cycles(s, d), 40.0, 120.0).select("battery_id", "cycle_index", "y_pred").filter("cycle_index > 3")


def labelled(s, d):
    c = cycles(s, d)
    return H.attach_rul(c, H.end_of_life(c))


def training(s, d):
    """The labelled rows with the columns that fits need, written once; folds are dealt and models fitted from these."""
    return written(labelled(s, d).select("battery_id", "cycle_index", "rul_cycles", *COLS), "labelled")


@query("mdl4_out_of_fold")
def _(s, d):
    r = training(s, d)
    return X.out_of_fold(r, S.grouped_folds(r, 3), 3, "ridge", COLS, "rul_cycles")


_TWO = ["capacity_ah", "temperature_max_c"]
_LOO = """with rows as (select battery_id, cycle_index, capacity_ah as a, temperature_max_c as b, cast(n_cycles - cycle_index as double) as y from cycles),
  own as (select battery_id, count(*) as n, sum(a) as sa, sum(b) as sb, sum(y) as sy, sum(a * a) as saa, sum(b * b) as sbb, sum(y * y) as syy, sum(a * b) as sab, sum(a * y) as say, sum(b * y) as sby
    from rows where a is not null and b is not null group by 1),
  rest as (select o.battery_id, sum(x.n) as n, sum(x.sa) / sum(x.n) as ma, sum(x.sb) / sum(x.n) as mb, sum(x.sy) / sum(x.n) as my, sum(x.saa) / sum(x.n) as aa, sum(x.sbb) / sum(x.n) as bb,
    sum(x.syy) / sum(x.n) as yy, sum(x.sab) / sum(x.n) as ab, sum(x.say) / sum(x.n) as ay, sum(x.sby) / sum(x.n) as by_ from own o join own x on o.battery_id <> x.battery_id group by 1),
  cov as (select battery_id, n, ma, mb, my, (aa - ma * ma) * (1 + 1.0 / sqrt(yy - my * my)) as p, (bb - mb * mb) * (1 + 1.0 / sqrt(yy - my * my)) as q, ab - ma * mb as r, ay - ma * my as u, by_ - mb * my as v from rest),
  fit as (select *, (u * q - v * r) / (p * q - r * r) as wa, (v * p - u * r) / (p * q - r * r) as wb from cov)
select c.battery_id, c.cycle_index, y as y_true, my + wa * (a - ma) + wb * (b - mb) as y_pred, 'ridge' as model from rows c left join fit using (battery_id)"""


@query("mdl4_leave_one_out", _LOO, "cycles", "y_true y_pred", digits=4)
def _(s, d):
    rows = cycles(s, d).withColumn("rul", (F.col("n_cycles") - F.col("cycle_index")).cast("double"))
    return X.leave_one_out(rows, _TWO, "rul")


@query("mdl3_families")
def _(s, d):
    r = training(s, d)
    train, test = r.filter("cast(battery_id as int) % 4 <> 0"), r.filter("cast(battery_id as int) % 4 = 0")
    out = None
    for f in X.REGRESSORS:
        p = X.pipeline(f, COLS, "rul_cycles").fit(train).transform(test)
        m = M.regression_metrics(p.select(F.lit(f).alias("model"), "y_pred", F.col("rul_cycles").cast("double").alias("y_true")), ["model"]).select("model", "n", "mae")
        out = m if out is None else out.union(m)
    return out


@query("mdl5_select_family")
def _(s, d):
    r = training(s, d)
    folds = S.grouped_folds(r, 2)
    return X.select_family(X.out_of_fold(r, folds, 2, ("ridge", "linear"), COLS, "rul_cycles"))


@query("mdl5_nested_selection")
def _(s, d):
    r = training(s, d)
    return X.nested_selection(r, S.grouped_folds(r, 3), 3, ("ridge", "linear"), COLS, "rul_cycles")


@query("mdl5_selection_frequency")
def _(s, d):
    r = training(s, d)
    return X.selection_frequency(X.nested_selection(r, S.grouped_folds(r, 3), 3, ("ridge", "linear"), COLS, "rul_cycles"))


@query("mdl3_risk_classifier")
def _(s, d):
    """Ranking quality, on entities that it has not seen, of a balanced classifier of the end of life within 30 cycles."""
    r = labelled(s, d).filter("rul_cycles is not null").select("battery_id", "cycle_index", (F.col("rul_cycles") <= 30).cast("int").alias("label"), *COLS).dropna()
    train, test = r.filter("cast(battery_id as int) % 4 <> 0"), r.filter("cast(battery_id as int) % 4 = 0")
    scored = X.risk_classifier(COLS, "label").fit(X.balanced(train, "label")).transform(test)
    return K.ranking_quality(scored.select(vector_to_array("probability")[1].alias("probability"), "label"))


@query("mdl6_search")
def _(s, d):
    r = training(s, d)
    r = r.join(S.grouped_folds(r, 3), "battery_id").withColumn("fold", F.col("fold").cast("int"))
    return s.createDataFrame([(float(a), float(b)) for a, b in X.search(r, ["capacity_ah", "temperature_max_c"], "rul_cycles")], "reg double, mae double")


@query("mdl7_scored_cycles", f"""
select battery_id, cycle_index, cycle_index <= 10 as is_warmup, case when cycle_index > 10 then y_pred end as y_pred, cycle_index + case when cycle_index > 10 then y_pred end as predicted_eol,
  abs(case when cycle_index > 10 then y_pred end - (n_cycles - cycle_index)) as abs_error from ({_MDL2})""", "cycles", "y_pred predicted_eol abs_error", digits=3)
def _(s, d):
    p = X.fade_extrapolation(cycles(s, d), 40.0, 120.0).withColumn("rul", (F.col("n_cycles") - F.col("cycle_index")).cast("double"))
    return X.scored_cycles(p, label="rul").select("battery_id", "cycle_index", "is_warmup", "y_pred", "predicted_eol", "abs_error")


@query("xpl1_permutation_importance")
def _(s, d):
    r = training(s, d)
    return X.permutation_importance(r, X.pipeline("ridge", COLS, "rul_cycles").fit(r), COLS, "rul_cycles")


@query("xpl2_ablation")
def _(s, d):
    r = training(s, d)
    return X.ablation(r, X.pipeline("ridge", COLS, "rul_cycles").fit(r), COLS, ["battery_id", "cycle_index"])


_FEATURES = {
    "capacity_ah_lag3": "capacity_ah", "soh_slope10": "value", "voltage_min_v_roll5_mean": "voltage_min_v", "temperature_max_c_roll20_std": "temperature_max_c", "ambient_temperature_c": "ambient_temperature_c",
    "internal_resistance_ohm_slope20": "internal_resistance_ohm", "discharge_duration_s": "discharge_duration_s", "cum_energy_wh": "energy_throughput_wh", "pos_in_life": "cycle_index", "other_signal": "value",
}
_NAME = "replace(regexp_replace(regexp_replace(regexp_replace(feature, '_roll(\\d+)_(\\w+)$', ' rolling \\2 (\\1)'), '_lag(\\d+)$', ' lag \\1'), '_slope(\\d+)$', ' slope (\\1)'), '_', ' ')"


@query("xpl3_signal_families", f"""
select family, sum(importance) as total, count(*) as n, string_agg(name, '; ' order by name) as names from (select *, {_NAME} as name, case when regexp_matches(feature, '^(capacity|soh)') then 'capacity' when regexp_matches(feature, '^voltage') then 'voltage'
  when regexp_matches(feature, '^(temperature|t_excess|ambient)') then 'temperature' when regexp_matches(feature, '^(internal_resistance|r_times|c_over_r)') then 'resistance'
  when regexp_matches(feature, '^(discharge|charge|cum_|energy)') then 'duty' when regexp_matches(feature, '^pos') then 'age' else 'other' end as family from (
    {" union all ".join(f"select '{k}' as feature, avg({v})::double as importance from cycles" for k, v in _FEATURES.items())})) group by 1""", "cycles", "total")
def _(s, d):
    wide = cycles(s, d).agg(*[F.avg(v).cast("double").alias(k) for k, v in _FEATURES.items()])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("importance")) for k in _FEATURES])))
    return X.family_importance(long)


@query("agg1_comparison", """
select battery_id, count(*) as n_cycles, arg_min(capacity_ah, cycle_index) as value_start, arg_max(capacity_ah, cycle_index) as value_end, max(temperature_max_c) as temperature_max, avg(ambient_temperature_c) as ambient,
  100 * (arg_min(capacity_ah, cycle_index) - arg_max(capacity_ah, cycle_index)) / nullif(arg_min(capacity_ah, cycle_index), 0) as fade_pct from cycles group by 1""", "cycles", "value_start value_end temperature_max ambient fade_pct")
def _(s, d):
    return H.comparison_summary(cycles(s, d))


@query("agg1_histogram", "select cast(least(floor(value * 10 / 250.0), 9) as int) as bin, count(*) as n from events where value is not null group by 1")
def _(s, d):
    from wanetrack.operators.drift import histogram

    return histogram(table(s, d, "events"), "value", 0.0, 250.0)


@query("agg1_robust_z", """
select count(*) filter (where abs(value - m) / (1.4826 * mad) > 3) as n_outliers, max(m) as median, max(mad) as mad from events, (
  select m, quantile_cont(abs(value - m), 0.5) as mad from events, (select quantile_cont(value, 0.5) as m from events) group by 1)""", "", "median mad")
def _(s, d):
    e = table(s, d, "events")
    m = e.agg(F.percentile("value", F.lit(0.5)).alias("m"))
    w = e.join(F.broadcast(m), F.lit(True), "cross")  # one row
    mad = w.agg(F.percentile(F.abs(F.col("value") - F.col("m")), F.lit(0.5)).alias("mad"))
    z = F.abs(F.col("value") - F.col("m")) / (1.4826 * F.col("mad"))
    return w.join(F.broadcast(mad), F.lit(True), "cross").agg(F.count_if(z > 3).alias("n_outliers"), F.max("m").alias("median"), F.max("mad").alias("mad"))


@query("agg1_correlations", " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as rho from cycles" for i, a in enumerate(COLS) for b in COLS[i + 1:]), "cycles", "rho")
def _(s, d):
    return P.correlations(cycles(s, d), COLS)
