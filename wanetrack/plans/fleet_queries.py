"""Queries for quality, fleet decisions, drift, performance, alerts and history tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wanetrack.operators import drift as D
from wanetrack.operators import fleet as L
from wanetrack.operators import monitoring as N
from wanetrack.operators import quality as Q
from wanetrack.plans.book import query
from wanetrack.plans.fixtures import fixture, table
from wanetrack.sources.stored import StoredTable
from wanetrack.sources.tables import shared_folder

SIG = ["capacity_ah", "internal_resistance_ohm", "temperature_max_c"]


def cycles(s, d):
    return fixture(s, d, "cycles")


def fleet(s, d):
    df = L.with_derived(fixture(s, d, "records"))
    return L.composite_score(L.priority(df))


_CLASS = "case when {0} is null then 'unknown' when {0} >= 0.8 then 'good' when {0} >= 0.6 then 'acceptable' when {0} >= 0.35 then 'poor' else 'insufficient' end"
_HEALTH = "case when {0} is null then 'unknown' when {0} >= 0.9 then 'healthy' when {0} >= 0.8 then 'slightly_degraded' when {0} >= 0.7 then 'warning' else 'critical' end"
_BASE = f"""select *, rul_upper_bound - rul_lower_bound as interval_width, {_HEALTH.format('measured_soh')} as health_class, {_CLASS.format('data_quality_score')} as data_quality_class,
  case when not risk_is_experimental then failure_risk end as r, coalesce(rul_lower_bound, predicted_rul) as l from records"""
_RULES = [
    ("INSUFFICIENT_DATA", "not_scored", "status <> 'success' or data_quality_class = 'insufficient'"), ("P0", "soh_floor", "measured_soh <= 0.70"),
    ("P0", "risk_and_life", "r >= 0.85 and l <= 5"), ("P0", "life_alone", "r is null and l <= 5"), ("P1", "risk_and_life", "r >= 0.60 and l <= 15"),
    ("P1", "life_alone", "r is null and l <= 15"), ("P2", "health", "health_class = 'warning'"), ("P2", "life", "l <= 40"), ("P2", "fade", "fade_trend_pct_per_10 >= 1.0"),
    ("P3", "degrading", "health_class = 'slightly_degraded' and fade_trend_pct_per_10 >= 0.5"),
    ("P5", "uncertain", "interval_width >= 60 or data_quality_class in ('poor', 'acceptable') or out_of_distribution_feature_count > 0"),
]
_PRIO = "select *, case " + " ".join(f"when {c} then '{p}'" for p, _, c in _RULES) + " else 'P4' end as priority, case " + " ".join(f"when {c} then '{n}'" for _, n, c in _RULES) + " else 'routine' end as rule from b"
_PRIO = f"""select * replace (case when priority <> 'INSUFFICIENT_DATA' and critical_data_warning then 'P0' else priority end as priority),
  concat_ws(',', case when priority <> 'INSUFFICIENT_DATA' and r is null and failure_risk is not null then 'risk_withheld' end, rule,
    case when priority <> 'INSUFFICIENT_DATA' and critical_data_warning then 'critical_data_warning' end) as triggered from ({_PRIO})"""
_PARTS = {"risk": "r", "rul": "1 - predicted_rul / 100", "rul_lower": "1 - rul_lower_bound / 100", "soh": "(1 - measured_soh) / 0.3", "fade": "fade_trend_pct_per_10 / 3", "width": "interval_width / 100", "quality": "1 - data_quality_score"}
_UNIT = "case when ({0}) is not null then least(greatest({0}, 0.0), 1.0) end"
_TOP = " + ".join(f"coalesce({L.WEIGHTS[k]}::double * {_UNIT.format(e)}, 0)" for k, e in _PARTS.items())
_LOW = " + ".join(f"case when ({e}) is not null then {L.WEIGHTS[k]}::double else 0 end" for k, e in _PARTS.items())
_SCORED = f"select *, case when priority = 'P0' then greatest(100 * ({_TOP}) / nullif({_LOW}, 0), 95.0) when priority <> 'INSUFFICIENT_DATA' then 100 * ({_TOP}) / nullif({_LOW}, 0) end as priority_score from p"
V = {"b": _BASE, "p": _PRIO, "f": _SCORED}

# --- quality -------------------------------------------------------------------------

_DQ_COLS = {"capacity_ah": (1.0, 9.0), "voltage_mean_v": (0.0, 3.2), "temperature_max_c": (-40.0, 90.0), "internal_resistance_ohm": (0.0, 0.08)}
_SUMS = " + ".join(f"cast(coalesce(min({c}) < {lo} or max({c}) > {hi}, false) as int)" for c, (lo, hi) in _DQ_COLS.items())
_DQ = f"""select battery_id, n, n_ood, missing, absent, greatest(1 - (case when n < 10 then 1.0 when n < 40 then 0.15 else 0.0 end + case when orders < n then 0.25 else 0.0 end + case when turned > 0 then 0.2 else 0.0 end
    + case when gap > 25 then 0.15 else 0.0 end + case when missing > 0.3 then 1.0 when missing > 0.05 then 0.25 else 0.0 end + case when implausible > 0 then 0.2 else 0.0 end + least(0.05 * n_ood, 0.25)), 0.0)::double as score,
  concat_ws(',', case when n < 10 then 'history' end, case when orders < n then 'duplicates' end, case when turned > 0 then 'ordering' end, case when gap > 25 then 'gaps' end, case when missing > 0.05 then 'missing' end,
    case when implausible > 0 then 'implausible' end, case when n_ood > 0 then 'ood' end) as failed_checks
  from (select battery_id, count(*) as n, count(distinct cycle_index) as orders, max(gap) as gap, count(*) filter (where turn <= 0) as turned, {_SUMS} as n_ood,
      count(*) filter (where capacity_ah <= 0 or capacity_ah > 4 or voltage_mean_v < 0 or voltage_mean_v > 5 or temperature_max_c < -40 or temperature_max_c > 100) as implausible,
      ({' + '.join(f"cast(count({c}) = 0 as int)" for c in _DQ_COLS)}) / 4.0::double as missing, concat_ws(',', {', '.join(f"case when count({c}) = 0 then '{c}' end" for c in _DQ_COLS)}) as absent
    from (select *, cycle_index - lag(cycle_index) over (partition by battery_id order by cycle_index) as gap, cycle_index - lag(cycle_index) over (partition by battery_id order by arrival) as turn from arrivals) group by 1)"""
_DQC = f"select *, case when n < 10 or missing > 0.3 then 'insufficient' else {_CLASS.format('score')} end as quality_class from ({_DQ})"


def ranges(s, columns=("capacity_ah", "internal_resistance_ohm", "temperature_max_c")):
    """(feature, low, high): fixed reference ranges."""
    known = {"capacity_ah": (0.0, 9.0), "internal_resistance_ohm": (0.0, 0.08), "temperature_max_c": (-40.0, 90.0)} if columns is not _DQ_COLS else _DQ_COLS
    return s.createDataFrame([(c, *known[c]) for c in columns], "feature string, low double, high double")


def scores(s, d):
    return Q.quality_scores(fixture(s, d, "arrivals"), list(_DQ_COLS), ranges(s, _DQ_COLS), arrival="arrival")


@query("dq1_quality_scores", f"select battery_id, n, n_ood, missing, absent, score, quality_class, failed_checks from ({_DQC})", "arrivals", "missing score")
def _(s, d):
    return scores(s, d)


@query("dq2_ood_features", f"select battery_id, n_ood, concat_ws(',', case when max_r > 0.08 then 'internal_resistance_ohm' end, case when max_t > 90 then 'temperature_max_c' end) as ood from (select battery_id, cast(max(internal_resistance_ohm) > 0.08 as int) + cast(max(temperature_max_c) > 90 as int) as n_ood from cycles group by 1) join (select battery_id, max(internal_resistance_ohm) as max_r, max(temperature_max_c) as max_t from cycles group by 1) using (battery_id)", "cycles")
def _(s, d):
    return Q.ood_features(cycles(s, d), ranges(s), SIG)


_FQ = f"""
select *, case when n = 0 then 'unknown' when poor_fraction >= 0.25 or insufficient_fraction >= 0.25 or mean_missing >= 0.3 then 'critical'
    when poor_fraction >= 0.1 or insufficient_fraction >= 0.1 or mean_missing >= 0.1 then 'warning' else 'ok' end as status from (
  select count(*) + 2 as n, avg(score) as mean_score, avg(missing) as mean_missing, (count(*) filter (where quality_class in ('poor', 'insufficient')) + 2) / (count(*) + 2) as poor_fraction,
    count(*) filter (where quality_class = 'insufficient') / (count(*) + 2) as insufficient_fraction,
    count(*) filter (where quality_class = 'good') as n_good, count(*) filter (where quality_class = 'acceptable') as n_acceptable, count(*) filter (where quality_class = 'poor') as n_poor,
    count(*) filter (where quality_class = 'insufficient') as n_insufficient from ({_DQC}))"""


@query("dq3_fleet_quality", _FQ, "arrivals", "mean_score mean_missing poor_fraction insufficient_fraction")
def fleet_quality(s, d):
    return Q.fleet_quality(scores(s, d), failed=2)


@query("dq3_failure_rates", " union all ".join(f"select '{c}' as check_name, avg(cast(list_contains(string_split(failed_checks, ','), '{c}') as int)) as rate from ({_DQC})" for c in Q.CHECKS), "arrivals", "rate")
def _(s, d):
    return Q.failure_rates(scores(s, d))


@query("dq3_absence_rates", " union all ".join(f"select '{c}' as feature, avg(cast(n = 0 as int)) as rate from (select count({c}) as n from arrivals group by battery_id)" for c in _DQ_COLS), "arrivals", "rate")
def _(s, d):
    return Q.absence_rates(scores(s, d), list(_DQ_COLS))


@query("dq4_quality_detail", f"select r.battery_id, r.status, quality_class, score, n, n_ood, missing, failed_checks as warnings from records r left join ({_DQC}) using (battery_id)", "records arrivals", "score missing")
def _(s, d):
    return Q.quality_detail(fixture(s, d, "records"), scores(s, d))


_STATE = """select battery_id, max(cycle_index) as latest_cycle, min(cycle_index) as first_cycle, count(*) as n_cycles, arg_max_null(capacity_ah, cycle_index) as capacity_ah,
  arg_max_null(internal_resistance_ohm, cycle_index) as internal_resistance_ohm, arg_max_null(temperature_max_c, cycle_index) as temperature_max_c, arg_min(capacity_ah, cycle_index) as first_value from cycles group by 1"""


@query("twn1_latest_state", f"""
select battery_id, latest_cycle, first_cycle, n_cycles, capacity_ah, internal_resistance_ohm, temperature_max_c, capacity_ah / 2.0 as measured_soh, 100 * (first_value - capacity_ah) / nullif(first_value, 0) as fade_pct,
  concat_ws(',', case when capacity_ah is not null then 'capacity_ah' end, case when internal_resistance_ohm is not null then 'internal_resistance_ohm' end, case when temperature_max_c is not null then 'temperature_max_c' end) as available,
  concat_ws(',', case when capacity_ah is null then 'capacity_ah' end, case when internal_resistance_ohm is null then 'internal_resistance_ohm' end, case when temperature_max_c is null then 'temperature_max_c' end) as missing_signals
from ({_STATE})""", "cycles", "capacity_ah internal_resistance_ohm temperature_max_c measured_soh fade_pct")
def _(s, d):
    return Q.latest_state(cycles(s, d), SIG)


@query("twn2_gate", f"""
select battery_id, latest_cycle, quality_class, reason, case when reason = 'no_features' then 'failed' when reason is not null then 'insufficient_data' else 'success' end as status from (
  select *, case when quality_class is null then 'no_features' when latest_cycle < 60 then 'warm_up' when quality_class = 'insufficient' then 'quality' end as reason from ({_STATE}) left join (select battery_id, quality_class from ({_DQC})) using (battery_id))""", "cycles arrivals")
def _(s, d):
    return Q.gate(Q.latest_state(cycles(s, d), SIG), scores(s, d), 60)


@query("twn3_withhold", "select battery_id, case when not risk_is_experimental then failure_risk end as failure_risk from records", "records", "failure_risk")
def _(s, d):
    return Q.withhold_experimental(fixture(s, d, "records")).select("battery_id", "failure_risk")


@query("twn4_forecast_warning", "select battery_id, coalesce(data_quality_score > measured_soh + 0.01, false) as forecast_warning from records", "records")
def _(s, d):
    return Q.forecast_warning(fixture(s, d, "records"), forecast="data_quality_score").select("battery_id", "forecast_warning")


# --- fleet ---------------------------------------------------------------------------


_HOT, _HARD = "temperature_trend_c_per_10 >= 0.5", "(resistance_trend_pct_per_10 >= 2.0 or fade_trend_pct_per_10 >= 1.0)"


@query("rec1_recommendation", f"""
select battery_id, case when rung <> 'advice' then rung when {_HOT} then 'reduce_heat' else 'reduce_charging' end as recommendation,
  case when rung in ('urgent', 'replace', 'inspect') then concat_ws(',', case when {_HOT} then 'reduce_heat' end, case when {_HARD} then 'reduce_charging' end)
    when rung = 'advice' and {_HOT} and {_HARD} then 'reduce_charging' else '' end as advisories from (
  select *, case when status <> 'success' or data_quality_class = 'insufficient' then 'insufficient_data' when l <= 5 or r >= 0.85 then 'urgent' when l <= 15 or r >= 0.6 or health_class = 'critical' then 'replace'
    when l <= 40 or r >= 0.3 or health_class = 'warning' then 'inspect' when {_HOT} or {_HARD} then 'advice' when health_class = 'slightly_degraded' then 'monitor' else 'normal' end as rung from b)""", "records", **V)
def _(s, d):
    return L.recommendation(fleet(s, d)).select("battery_id", "recommendation", "advisories")


@query("rec2_evidence", """
select battery_id, concat_ws(' ', case when measured_soh is not null then printf('Health %.2f (%s).', measured_soh, health_class) end,
  case when predicted_rul is not null and rul_lower_bound is not null then printf('Life %d cycles, at least %d.', cast(floor(predicted_rul) as int), cast(floor(rul_lower_bound) as int)) when predicted_rul is not null then printf('Life %d cycles.', cast(floor(predicted_rul) as int)) end,
  case when r is not null then printf('Failure risk %.2f (%s).', r, case when r < 0.2 then 'low' when r < 0.5 then 'moderate' when r < 0.8 then 'high' else 'critical' end) when failure_risk is not null then 'Failure risk is experimental and not used.' end,
  case when temperature_trend_c_per_10 is not null then printf('Temperature trend %+.2f C in 10 cycles.', temperature_trend_c_per_10) end,
  case when resistance_trend_pct_per_10 is not null then printf('Resistance trend %+.2f %% in 10 cycles.', resistance_trend_pct_per_10) end,
  case when fade_trend_pct_per_10 is not null then printf('Fade trend %+.2f %% in 10 cycles.', fade_trend_pct_per_10) end, printf('Data quality %s.', data_quality_class)) as evidence from b""", "records", **V)
def _(s, d):
    return L.evidence(fleet(s, d)).select("battery_id", "evidence")


@query("flt1_priority", "select battery_id, priority, rule, triggered from p", "records", **V)
def _(s, d):
    return fleet(s, d).select("battery_id", "priority", "rule", "triggered")


_ACT = "case priority " + " ".join(f"when '{k}' then '{v}'" for k, v in L.ACTIONS.items()) + " end"


@query("flt2_action", f"select battery_id, {_ACT} as action from p", "records", **V)
def _(s, d):
    return fleet(s, d).select("battery_id", L.action().alias("action"))


_WIN = "case when w is not null then cast(case when l is null then greatest(w, 0) else greatest(least(w, floor(l)), 0) end as bigint) end"


@query("flt3_inspection_window", f"select battery_id, {_WIN} as inspect_within_cycles, {_WIN} / n_cycles as inspect_within_days from (select *, case priority when 'P0' then 0 when 'P1' then 5 when 'P2' then 10 when 'P3' then 20 end as w from p)", "records", "inspect_within_days", **V)
def _(s, d):
    return L.inspection_window(fleet(s, d), "n_cycles").select("battery_id", "inspect_within_cycles", "inspect_within_days")


@query("flt4_composite_score", "select battery_id, priority_score from f", "records", "priority_score", **V)
def flagship(s, d):
    return fleet(s, d).select("battery_id", "priority_score")


@query("flt5_score_breakdown", " union all ".join(f"select battery_id, '{k}' as component, {_UNIT.format(e)} as value, {L.WEIGHTS[k]}::double as weight, 100 * {L.WEIGHTS[k]}::double * {_UNIT.format(e)} / nullif({_LOW}, 0) as points from p where priority <> 'INSUFFICIENT_DATA'" for k, e in _PARTS.items()), "records", "value weight points", **V)
def _(s, d):
    return L.score_breakdown(fleet(s, d))


_HZ = """select *, case when base = 'insufficient' then base when r >= 0.6 or measured_soh <= 0.72 or priority in ('P0', 'P1') then 'near' else base end as horizon,
  interval_width / greatest(predicted_rul, 1.0) as ratio from (select *, case when priority = 'INSUFFICIENT_DATA' or l is null then 'insufficient' when l <= 20 then 'near' when l <= 50 then 'medium' when l <= 100 then 'long' else 'beyond' end as base from p)"""


@query("flt6_replacement_horizon", f"select battery_id, horizon, case when horizon = 'insufficient' then 'none' when ratio <= 0.5 and data_quality_class = 'good' then 'high' when ratio <= 1.0 then 'medium' else 'low' end as confidence from ({_HZ})", "records", **V)
def _(s, d):
    return L.replacement_horizon(fleet(s, d)).select("battery_id", "horizon", "confidence")


@query("flt7_replacement_summary", f"""
select t.horizon, (select count(*) from ({_HZ}) h where h.horizon = t.horizon) as n, case when lim is not null then (select count(*) from b where rul_upper_bound <= lim) end as optimistic,
  case when lim is not null then (select count(*) from b where rul_lower_bound <= lim) end as conservative from (values ('near', 20), ('medium', 50), ('long', 100), ('beyond', null), ('insufficient', null)) t(horizon, lim)""", "records", **V)
def _(s, d):
    return L.replacement_summary(L.replacement_horizon(fleet(s, d)))


def _bucket(life):
    return f"case when priority = 'INSUFFICIENT_DATA' then 'insufficient' when {life} is null then 'monitor_only' when priority = 'P0' then 'immediate' when {life} <= 10 then 'next_10' when {life} <= 30 then 'next_30' when {life} <= 50 then 'next_50' else 'beyond_50' end"


@query("flt8_workload", f"""
select t.bucket, (select count(*) from q where q.bucket = t.bucket) as n, (select count(*) from q where if_lower = t.bucket) as n_if_lower, (select count(*) from q where if_upper = t.bucket) as n_if_upper,
  case when t.bucket <> 'insufficient' then 100.0::double * (select count(*) from q where q.bucket = t.bucket) / (select count(*) from q where q.bucket <> 'insufficient') end as pct
from (values {', '.join(f"('{b}')" for b in L.BUCKETS)}) t(bucket)""", "records", "pct", **V, q=f"select {_bucket('l')} as bucket, {_bucket('coalesce(rul_lower_bound, l)')} as if_lower, {_bucket('coalesce(rul_upper_bound, l)')} as if_upper from p")
def _(s, d):
    return L.workload(fleet(s, d))


@query("flt9_health_distribution", "select health_class, count(*) as n, count(*) / sum(count(*)) over () as fraction from b where status = 'success' and health_class <> 'unknown' group by 1", "records", "fraction", **V)
def _(s, d):
    return L.health_distribution(fleet(s, d))


@query("flt10_risk_distribution", """
select count(r) as n, count(*) filter (where r is null) as n_unknown, avg(r) as mean, quantile_cont(r, 0.25) as q25, quantile_cont(r, 0.5) as q50, quantile_cont(r, 0.75) as q75, quantile_cont(r, 0.9) as q90,
  count(*) filter (where r > 0.5) as above_50, count(*) filter (where r > 0.8) as above_80 from b where status = 'success'""", "records", "mean q25 q50 q75 q90", **V)
def _(s, d):
    return L.risk_distribution(fleet(s, d))


@query("flt11_maintenance_summary", f"select priority, count(*) as n, coalesce(string_agg(case when priority = 'P0' then battery_id end, ',' order by battery_id), '') as critical_ids, any_value({_ACT}) as action from p group by 1", "records", **V)
def _(s, d):
    return L.maintenance_summary(fleet(s, d))


@query("flt12_fleet_statistics", " union all ".join(f"select '{c}' as quantity, count({c}) as n, count(*) - count({c}) as missing, avg({c}) as mean, quantile_cont({c}, 0.5) as median from b where status = 'success'" for c in ("measured_soh", "predicted_rul", "r", "interval_width")), "records", "mean median", **V)
def _(s, d):
    return L.fleet_statistics(fleet(s, d))


@query("flt13_snapshot_summary", """
select count(*) as submitted, count(distinct battery_id) as entities, count(*) filter (where status = 'success') as succeeded, count(*) filter (where status = 'failed') as failed,
  count(*) filter (where status = 'insufficient_data') as insufficient, count(*) = count(distinct battery_id) as complete from records""", "records")
def _(s, d):
    return L.snapshot_summary(fleet(s, d))


@query("flt14_snapshot_trend", "select event_type as fleet_id, cast(cast(ts as date) as string) as day, count(value) as n, quantile_cont(value, 0.5) as median, avg(value) as mean from events group by 1, 2", "", "median mean")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("fleet_id"), F.col("ts").cast("date").cast("string").alias("day"), "value")
    return L.snapshot_trend(e, ["fleet_id", "day"], "value")


_META = """select battery_id, case when cast(battery_id as int) % 2 = 0 then 'nmc' else 'lfp' end as chemistry, case when cast(battery_id as int) % 5 <> 0 then 'maker ' || cast(cast(battery_id as int) % 4 as varchar) end as manufacturer
  from records where cast(battery_id as int) % 3 <> 0"""


@query("flt15_passport", f"""
select battery_id, measured_soh, predicted_rul, case when measured_soh is null then 'unknown' when measured_soh <= 0.7 then 'end_of_first_life' when measured_soh <= 0.8 then 'second_life_candidate' else 'in_service' end as lifecycle_status,
  coalesce(measured_soh <= 0.7, false) and chemistry is not null and manufacturer is not null as recycling_ready,
  case when coalesce(measured_soh <= 0.7, false) then concat_ws(',', case when chemistry is null then 'chemistry' end, case when manufacturer is null then 'manufacturer' end) else 'in_use' end as awaits, chemistry, manufacturer,
  case when measured_soh is null then 'not_available' else 'measured' end as measured_soh_source, case when predicted_rul is null then 'not_available' else 'predicted' end as predicted_rul_source,
  case when chemistry is null then 'not_supplied' else 'supplied' end as chemistry_source, case when manufacturer is null then 'not_supplied' else 'supplied' end as manufacturer_source from records left join ({_META}) using (battery_id)""", "records", "measured_soh predicted_rul")
def _(s, d):
    r = fixture(s, d, "records")
    i = F.col("battery_id").cast("int")
    maker = F.when(i % 5 != 0, F.concat(F.lit("maker "), (i % 4).cast("string")))
    return L.passport(r, r.filter(i % 3 != 0).select("battery_id", F.when(i % 2 == 0, "nmc").otherwise("lfp").alias("chemistry"), maker.alias("manufacturer")))


_SUCCESS = "status = 'success'"


def _ranked(k, where):
    more = "priority_score desc nulls last, " if k == "priority" else ""
    return f"select '{k}' as key, battery_id, row_number() over (order by {k} {'desc' if L.RANK_KEYS[k] else 'asc'} nulls last, {more}battery_id) as rank from f where {where}"


@query("rnk1_rank_fleet", " union all ".join(f"(select * from ({_ranked(k, _SUCCESS)}) where rank <= 20)" for k in L.RANK_KEYS), "records", **V)
def _(s, d):
    f, out = fleet(s, d), None
    for k in L.RANK_KEYS:
        top = L.rank_fleet(f, k, 20, tail=False)
        part = L.ranking_table(top, k).select(F.lit(k).alias("key"), "battery_id", "rank")  # 20 rows
        out = part if out is None else out.union(part)
    return out


@query("rnk1_with_tail", "select battery_id from (select battery_id from f order by status = 'success' desc, case when status = 'success' then measured_soh end nulls last, battery_id) limit 1000000", "records", **V)
def _(s, d):
    return L.rank_fleet(fleet(s, d), "measured_soh").select("battery_id")


@query("rnk2_ranking_table", "select battery_id, row_number() over (order by fade_trend_pct_per_10 desc nulls last, battery_id) as rank from f", "records", **V)
def _(s, d):
    return L.ranking_table(fleet(s, d), "fade_trend_pct_per_10").select("battery_id", "rank")


@query("rnk3_page", "select battery_id, (select count(*) from f) as total from (select battery_id from f order by predicted_rul nulls last, battery_id limit 10 offset 20)", "records", **V)
def _(s, d):
    return L.page(fleet(s, d), 3, 10, "predicted_rul").select("battery_id", "total")


@query("rnk4_critical_list", "select battery_id, priority from p where priority in ('P0', 'P1')", "records", **V)
def _(s, d):
    return L.critical_list(fleet(s, d)).select("battery_id", "priority")


# --- drift ---------------------------------------------------------------------------

_CUT = "timestamp '2024-01-16'"


def halves(s, d):
    e = table(s, d, "events").withColumn("value2", F.col("value") * 2)
    cut = F.expr("timestamp_ntz '2024-01-16'")
    return e.filter(F.col("ts") < cut), e.filter(F.col("ts") >= cut).withColumn("value", F.col("value") * 1.2)


VD = {
    "ra": f"select *, value * 2 as value2 from events where ts < {_CUT}", "cu": f"select * replace (value * 1.2 as value), value * 2 as value2 from events where ts >= {_CUT}",
    "ed": "select list_sort(list_distinct([" + ", ".join(f"quantile_cont(value, {i / 10})" for i in range(1, 10)) + "])) as e from ra",
    "fr": "select len(list_filter((select e from ed), lambda x: value > x)) as bin, count(*) / sum(count(*)) over () as f from ra group by 1",
    "fc": "select len(list_filter((select e from ed), lambda x: value > x)) as bin, count(*) / sum(count(*)) over () as f from cu group by 1",
    "al": "select bin, r / sum(r) over () as r, c / sum(c) over () as c from (select bin, greatest(coalesce(fr.f, 0), 1e-6) as r, greatest(coalesce(fc.f, 0), 1e-6) as c from fr full join fc using (bin))",
}


@query("ref1_numeric_reference", " union all ".join(f"""select '{c}' as feature, count({c}) as n, avg(cast({c} is null as int)) as missing_rate, avg({c}) as mean, stddev_samp({c}) as std, min({c}) as low, max({c}) as high,
  quantile_cont({c}, 0.5) as median, quantile_cont({c}, 0.95) as q95, 9 as n_edges, false as constant from ra""" for c in ("value", "value2")), "", "missing_rate mean std low high median q95", **VD)
def _(s, d):
    r = D.numeric_reference(halves(s, d)[0], ["value", "value2"])
    return r.select("feature", "n", "missing_rate", "mean", "std", "low", "high", F.col("quantiles")[3].alias("median"), F.col("quantiles")[5].alias("q95"), F.size("edges").alias("n_edges"), "constant")


@query("ref2_categorical_reference", "select 'event_type' as feature, event_type as category, count(*) as n, count(*) / sum(count(*)) over () as proportion from ra group by 2", "", "proportion", **VD)
def _(s, d):
    return D.categorical_reference(halves(s, d)[0], "event_type")


@query("ref3_every_kth", "select event_id from (select event_id, row_number() over (order by event_id) - 1 as rn, ceil(count(*) over () / 500.0) as k from ra) where rn % k = 0", "", **VD)
def _(s, d):
    return D.every_kth(halves(s, d)[0], ["event_id"], 500).select("event_id")


@query("ref4_reference_rows", "select count(*) as n from cycles where cast(battery_id as int) % 5 < 3", "cycles")
def _(s, d):
    c = cycles(s, d).withColumn("split", F.when(F.col("battery_id").cast("int") % 5 < 3, "train").otherwise("test"))
    return D.reference_rows(c, ("train", "test")).agg(F.count(F.lit(1)).alias("n"))


@query("ref5_current_batch", "select battery_id, cycle_index from cycles qualify row_number() over (partition by battery_id order by cycle_index desc) <= 10", "cycles")
def _(s, d):
    return D.current_batch(cycles(s, d)).select("battery_id", "cycle_index")


def both(s, d):
    r, c = halves(s, d)
    ref = D.numeric_reference(r, ["value"])
    return D.aligned(D.bin_frequencies(r, ref, ["value"]), D.bin_frequencies(c, ref, ["value"]))


@query("drf1_psi", "select 'value' as feature, sum((c - r) * ln(c / r)) as psi from al", "", "psi", **VD)
def _(s, d):
    return D.population_stability(both(s, d)).select("feature", "psi")


@query("drf2_js", "select 'value' as feature, sum(r * ln(2 * r / (r + c)) + c * ln(2 * c / (r + c))) / 2 as js from al", "", "js", **VD)
def _(s, d):
    return D.population_stability(both(s, d)).select("feature", "js")


def _quantiles(c):
    """The sample that stored quantiles stand for, as SQL over the reference rows."""
    lo, hi = D.QUANTILES[0], D.QUANTILES[-1]
    q = [f"quantile_cont({c}, {x})" for x in D.QUANTILES]
    steps = " ".join(f"when p <= {p1}::double then q[{k + 1}] + (q[{k + 2}] - q[{k + 1}]) * ((p - {p0}::double) / {p1 - p0!r}::double)" for k, (p0, p1) in enumerate(zip(D.QUANTILES, D.QUANTILES[1:], strict=False)))
    return f"select case {steps} else q[{len(q)}] end as v from (select {lo}::double + i * {(hi - lo) / 199!r}::double as p from range(200) t(i)), (select [{', '.join(q)}] as q from ra)"


def _two(c):
    return f"""select max(dd) as ks, coalesce(sum(dd * step), 0) as wasserstein, cast(sum(x) as bigint) as n, cast(sum(y) as bigint) as m from (
  select x, y, abs(sum(x) over w / sum(x) over () - sum(y) over w / sum(y) over ()) as dd, lead(v) over (order by v) - v as step from (
    select v, sum(x) as x, sum(y) as y from (select v, 1 as x, 0 as y from ({_quantiles(c)}) union all select {c}, 0, 1 from cu) where v is not null group by 1) window w as (order by v rows between unbounded preceding and current row))"""


def sampled(s, d):
    r, c = halves(s, d)
    return D.two_sample(D.quantile_sample(D.numeric_reference(r, ["value"])), c)


@query("drf3_ks", f"select ks, n, m from ({_two('value')})", "", "ks", **VD)
def _(s, d):
    return sampled(s, d).select("ks", "n", "m")


@query("drf4_wasserstein", f"select wasserstein, wasserstein / (select stddev_samp(value) from ra) as scaled from ({_two('value')})", "", "wasserstein scaled", **VD)
def _(s, d):
    r, _ = halves(s, d)
    std = r.agg(F.stddev_samp("value").alias("std"))
    return sampled(s, d).join(std, F.lit(True), "cross").select("wasserstein", (F.col("wasserstein") / F.col("std")).alias("scaled"))  # one row each


@query("drf5_chi_square", """
select sum((a - sa * t / (sa + sb)) ** 2 / (sa * t / (sa + sb)) + (b - sb * t / (sa + sb)) ** 2 / (sb * t / (sa + sb))) as chi2, count(*) - 1 as dof, sum(case when unseen then b else 0 end) / max(sb) as unseen_rate from (
  select *, a + b as t, sum(a) over () as sa, sum(b) over () as sb from (select coalesce(x.n, 0) as a, coalesce(y.n, 0) as b, x.n is null as unseen from
    (select event_type, count(*) as n from ra where event_type <> 'signup' group by 1) x full join (select event_type, count(*) as n from cu group by 1) y using (event_type)))""", "", "chi2 unseen_rate", **VD)
def _(s, d):
    r, c = halves(s, d)
    n = lambda x: D.categorical_reference(x, "event_type").select("category", "n")
    return D.chi_square(n(r.filter("event_type <> 'signup'")), n(c))


_TESTS = "select battery_id as feature, case when cast(battery_id as int) % 7 = 0 then null else cast(cast(battery_id as int) as double) / 2000 end as p from records"


@query("drf6_adjust_p", """
select feature, case when p is not null then least(min(q) over (partition by p is null order by p, feature rows between current row and unbounded following), 1.0) end as adjusted from (
  select *, p * count(p) over (partition by p is null) / row_number() over (partition by p is null order by p, feature) as q from t)""", "records", "adjusted", t=_TESTS)
def _(s, d):
    i = F.col("battery_id").cast("int")
    t = fixture(s, d, "records").select(F.col("battery_id").alias("feature"), F.when(i % 7 != 0, i.cast("double") / 2000).alias("p_value"))
    return D.adjust_p(t).select("feature", "adjusted")


def drifting(s, d):
    """A reference and a batch with a shifted, an unchanged, a constant, a lost, a new and a rare feature of numbers, and of categories
    one with an unseen category, one with two, one that has kept its shares, a single one, a lost and a rare one."""
    r, c = halves(s, d)
    spaced = F.col("event_id") % 500 == 0
    few = c.filter(spaced & F.col("event_type").isNotNull()).select("event_id", F.lit(True).alias("few")).orderBy("event_id").limit(20)  # rare in tables of any size
    c = c.join(F.broadcast(few), "event_id", "left")
    r = r.withColumns({"flat": F.lit(1.0), "gone": F.col("value"), "rare": F.col("value")})
    c = c.withColumns({"flat": F.lit(1.0), "fresh": F.col("value"), "rare": F.when(F.col("few"), F.col("value"))})
    kind, early = F.col("event_type"), F.col("event_id") % 3 == 0
    two = F.when(kind == "click", "yes").otherwise("no")
    r = r.withColumns({"kind": F.when(kind != "signup", kind), "two": two, "same": F.when(early, "a").otherwise("b"), "only": F.lit("x"), "lost": kind, "seldom": kind})
    c = c.withColumns({"kind": kind, "two": F.when(F.col("event_id") % 20 == 0, "yes").otherwise(two), "same": F.when(early, "a").otherwise("b"), "only": F.lit("x"), "seldom": F.when(F.col("few"), kind)})
    ref = ["value", "value2", "flat", "gone", "rare"]
    known = D.with_frequencies(D.numeric_reference(r, ref), r, ref)
    named = D.categorical_references(r, ["kind", "two", "same", "only", "lost", "seldom"])
    return D.feature_drift(known, c, ["value", "value2", "flat", "fresh", "rare"], categories=named, labels=["kind", "two", "same", "only", "seldom"])


_SERIES = "list_sum(list_transform(range(0, 400), lambda i: exp(-h + (a + i) * ln(h) - lgamma(a + i + 1))))"


def _chi(ra, cu):
    """chi2, degrees of freedom, tail and unseen rate of two samples of categories, as SQL."""
    return f"""select chi2, dof, case when h <= 0 then 1.0 when h > a + 300 then 0.0 else least(greatest(1 - {_SERIES}, 0.0), 1.0) end as p_value, unseen_rate from (
  select *, chi2 / 2 as h, dof / 2 as a from (select sum(power(greatest(abs(x - ex) - y, 0), 2) / ex + power(greatest(abs(z - ez) - y, 0), 2) / ez) as chi2, count(*) - 1 as dof, sum(case when unseen then z else 0 end) / max(sz) as unseen_rate from (
    select *, sx * (x + z) / (sx + sz) as ex, sz * (x + z) / (sx + sz) as ez, case when count(*) over () = 2 then 0.5 else 0.0 end as y from (
      select *, sum(x) over () as sx, sum(z) over () as sz from (select coalesce(p.n, 0) as x, coalesce(q.n, 0) as z, p.n is null as unseen from
        (select {ra} as c, count(*) as n from ra where ({ra}) is not null group by 1) p full join (select {cu} as c, count(*) as n from cu where ({cu}) is not null group by 1) q using (c))))))"""


def _bins(c):
    edges = "(select list_sort(list_distinct([" + ", ".join(f"quantile_cont({c}, {i / 10})" for i in range(1, 10)) + "])) from ra)"
    part = lambda v: f"select len(list_filter({edges}, lambda x: {c} > x)) as bin, count(*) / sum(count(*)) over () as f from {v} where {c} is not null group by 1"
    return f"""select sum((c - r) * ln(c / r)) as psi, sum(r * ln(2 * r / (r + c)) + c * ln(2 * c / (r + c))) / 2 as js from (select r / sum(r) over () as r, c / sum(c) over () as c from (
  select greatest(coalesce(x.f, 0), 1e-6) as r, greatest(coalesce(y.f, 0), 1e-6) as c from ({part('ra')}) x full join ({part('cu')}) y using (bin)))"""


_P = """case when t < 0.2 then 1.0 else least(greatest(list_sum(list_transform(range(1, 100), lambda k: exp(-2.0 * k * k * t * t) * (case when k % 2 = 1 then 2.0 else -2.0 end))), 0.0), 1.0) end"""
_EN = "sqrt(n::double * m / (n + m))"
_SCORED = " union all ".join(f"""
  select '{c}' as feature, 'psi' as metric, psi as value, null::double as p_value from ({_bins(c)}) union all select '{c}', 'js', js, null from ({_bins(c)}) union all
  select '{c}', 'ks', ks, {_P} from (select *, ({_EN} + 0.12 + 0.11 / {_EN}) * ks as t from ({_two(c)})) union all select '{c}', 'wasserstein', wasserstein / (select stddev_samp({c}) from ra), null from ({_two(c)})""" for c in ("value", "value2"))
_TWO = "case when event_type = 'click' then 'yes' else 'no' end"
_THIRD = "case when event_id % 3 = 0 then 'a' else 'b' end"
_SCORED += "".join(f" union all select '{c}', 'chi2', chi2, p_value from ({_chi(*x)}) union all select '{c}', 'unseen_rate', unseen_rate, null from ({_chi(*x)})" for c, x in (
    ("kind", ("case when event_type <> 'signup' then event_type end", "event_type")), ("two", (_TWO, f"case when event_id % 20 = 0 then 'yes' else {_TWO} end")), ("same", (_THIRD, _THIRD)),
))
_ODD = " union all ".join(f"select '{c}', '{k}', null::double, null::double" for c, k in (
    ("flat", "constant"), ("gone", "missing"), ("fresh", "new"), ("rare", "small_sample"), ("only", "small_sample"), ("lost", "missing"),
))
_ODD += " union all select 'seldom', case when count(*) = 0 then 'constant' else 'small_sample' end, null, null from cu where event_id % 500 = 0 and event_type is not null"
_LEVEL = lambda i: "case metric " + " ".join(f"when '{k}' then {v[i]}" for k, v in D.DRIFT_LEVELS.items()) + " end"
VF = {
    **VD, "t0": f"{_SCORED} union all {_ODD}",
    "t1": """select *, case when p_value is not null then least(min(q) over (partition by p_value is null order by p_value, feature rows between current row and unbounded following), 1.0) end as adjusted from (
      select *, p_value * count(p_value) over (partition by p_value is null) / row_number() over (partition by p_value is null order by p_value, feature) as q from t0)""",
    "fd": f"""select feature, metric, value, p_value, adjusted, value is not null as reliable, case when value is null then 'unknown' when metric = 'chi2' and p_value <= 0.05 and coalesce(adjusted <= 0.05, true) then 'warning' when value >= {_LEVEL(1)} and coalesce(adjusted <= 0.05, true) then 'critical'
      when value >= {_LEVEL(0)} and coalesce(adjusted <= 0.05, true) then 'warning' else 'ok' end as severity from t1""",
    "fl": """select *, case when n = 0 then 'unknown' when fraction >= 0.25 or c > 0 then 'critical' when fraction >= 0.1 or n_drifted > 0 then 'warning' else 'ok' end as status from (
      select count(distinct feature) filter (where reliable) as n, count(distinct feature) filter (where severity in ('warning', 'critical')) as n_drifted, count(*) filter (where severity = 'critical') as c,
        count(distinct feature) filter (where not reliable) as n_skipped, coalesce(count(distinct feature) filter (where severity in ('warning', 'critical')) / nullif(count(distinct feature) filter (where reliable), 0), 0.0) as fraction from fd)""",
}


@query("drf7_severity", "select *, severity in ('warning', 'critical') as drifted from fd", "", "value p_value adjusted", **VF)
def _(s, d):
    return drifting(s, d)


@query("drf7_fleet_drift", "select n, n_drifted, n_skipped, fraction, status from fl", "", "fraction", **VF)
def fleet_drift(s, d):
    return D.fleet_drift(drifting(s, d))


@query("drf3_ks_p_value", f"select ks, {_P} as p_value from (select *, ({_EN} + 0.12 + 0.11 / {_EN}) * ks as t from ({_two('value')}))", "", "ks p_value", **VD)
def _(s, d):
    return sampled(s, d).select("ks", D.ks_p(F.col("ks"), F.col("n"), F.col("m")).alias("p_value"))


@query("drf5_p_value", f"select chi2, dof, p_value from ({_chi('event_type', 'event_type')})", "", "chi2 p_value", **VD)
def _(s, d):
    n = lambda x: D.categorical_reference(x, "event_type").select("category", "n")
    r, c = halves(s, d)
    return D.chi_square(n(r), n(c)).select("chi2", "dof", D.chi_square_p(F.col("chi2"), F.col("dof").cast("int")).alias("p_value"))


@query("drf7_unadjusted", "select feature, metric, case when value is null then 'unknown' when metric = 'chi2' then case when p_value <= 0.05 then 'warning' else 'ok' end when value >= " + _LEVEL(1) + " then 'critical' when value >= " + _LEVEL(0) + " then 'warning' else 'ok' end as severity from t0", "", **VF)
def _(s, d):
    return D.drift_severity(D.adjust_p(drifting(s, d).select("feature", "metric", "value", "p_value"), "none")).select("feature", "metric", "severity")


@query("pdr1_prediction_summary", " union all ".join(f"select '{c}' as output, count({c}) as n, avg({c}) as mean, stddev_samp({c}) as std, quantile_cont({c}, 0.05) as q5, quantile_cont({c}, 0.5) as q50, quantile_cont({c}, 0.95) as q95 from records" for c in ("predicted_rul", "failure_risk")), "records", "mean std q5 q50 q95")
def _(s, d):
    return D.prediction_summary(fixture(s, d, "records"), ["predicted_rul", "failure_risk"]).select("output", "n", "mean", "std", "q5", "q50", "q95")


@query("pdr2_prediction_shift", """
select 'value' as output, (b.m - a.m) / a.s as mean_shift, (b.q5 - a.q5) / a.s as q5_shift, (b.q50 - a.q50) / a.s as q50_shift, (b.q95 - a.q95) / a.s as q95_shift
from (select avg(value) as m, stddev_samp(value) as s, quantile_cont(value, 0.05) as q5, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.95) as q95 from ra) a,
  (select avg(value) as m, quantile_cont(value, 0.05) as q5, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.95) as q95 from cu) b""", "", "mean_shift q5_shift q50_shift q95_shift", **VD)
def _(s, d):
    r, c = halves(s, d)
    return D.prediction_shift(D.prediction_summary(r, ["value"]), D.prediction_summary(c, ["value"]))


def _drift_sql(outputs, classes, width=None):
    """The report of output by output, as SQL over ra and cu; outputs: (name, expression in ra, expression in cu)."""
    rows = []
    for o, x, y in outputs:
        stat = lambda e, v: f"(select avg({e}) as m, stddev_samp({e}) as s, min({e}) as l, max({e}) as h, quantile_cont({e}, 0.1) as q10, quantile_cont({e}, 0.5) as q50, quantile_cont({e}, 0.9) as q90 from {v})"
        both = f"{stat(x, 'ra')} a, {stat(y, 'cu')} b"
        rows += [f"select '{o}' as output, 'mean_shift' as metric, abs(b.m - a.m) / a.s as value from {both}"] + [f"select '{o}[{q}]', 'quantile_shift', abs(b.{q} - a.{q}) / a.s from {both}" for q in ("q10", "q50", "q90")]
        own = lambda e, v: f"select least(floor(({e} - l) * 10 / (h - l)), 9) as bin, count(*) / sum(count(*)) over () as f, any_value(l) as l, any_value(h) as h from {v}, (select min({e}) as l, max({e}) as h from {v}) where {e} is not null group by 1"
        moved = f"select least(greatest(floor((c.l + (c.bin + 0.5) * (c.h - c.l) / 10 - r.l) * 10 / (r.h - r.l)), 0), 9) as bin, sum(f) as f from ({own(y, 'cu')}) c, (select min({x}) as l, max({x}) as h from ra) r group by 1"
        rows.append(f"""select '{o}', 'psi', sum((c - r) * ln(c / r)) from (select r / sum(r) over () as r, c / sum(c) over () as c from (
          select greatest(coalesce(p.f, 0), 1e-6) as r, greatest(coalesce(q.f, 0), 1e-6) as c from ({own(x, 'ra')}) p full join ({moved}) q using (bin)))""")
        if o == width:
            rows.append(f"select '{o}', 'width_ratio', b.q50 / a.q50 from {both}")
    share = lambda e, v: f"(select {e} as c, count(*) / sum(count(*)) over () as f from {v} where ({e}) is not null group by 1)"
    rows += [f"select '{o}', 'class_distance', 0.5 * sum(abs(coalesce(p.f, 0) - coalesce(q.f, 0))) from {share(x, 'ra')} p full join {share(y, 'cu')} q using (c)" for o, x, y in classes]
    level = lambda i: "case metric " + " ".join(f"when '{k}' then {v[i]}" for k, v in D.SHIFT_LEVELS.items()) + " end"
    return f"select *, case when value >= {level(1)} then 'critical' when value >= {level(0)} then 'warning' else 'ok' end as severity from ({' union all '.join(rows)})"


_REPORT = _drift_sql([("value", "value", "value"), ("value2", "value2", "value2"), ("interval_width", "value2", "value2 * 1.5")],
                     [("event_type", "event_type", "event_type"), ("band", "event_type", "case when event_id % 5 < 2 then 'click' else event_type end")], "interval_width")
_STATUS = "select case when count(*) filter (where severity = 'critical') > 0 then 'critical' when count(*) filter (where severity = 'warning') > 0 then 'warning' when count(*) > 0 then 'ok' else 'unknown' end as status, count(*) filter (where severity in ('warning', 'critical')) as n_drifted, count(*) as n_tests"


def predicted(s, d):
    """Two batches of outputs: one shifted, one as before, wider intervals, kept class shares, and moved ones."""
    r, c = halves(s, d)
    r = r.withColumns({"interval_width": F.col("value2"), "band": F.col("event_type")})
    c = c.withColumns({"interval_width": F.col("value2") * 1.5, "band": F.when(F.col("event_id") % 5 < 2, "click").otherwise(F.col("event_type"))})
    return r, c


def outputs_drift(s, d, few=False):
    r, c = predicted(s, d)
    return D.prediction_drift(r, c.orderBy("event_id").limit(19) if few else c, ["value", "value2", "interval_width"], ["event_type", "band"])


@query("pdr2_report", f"select *, severity in ('warning', 'critical') as drifted from ({_REPORT})", "", "value", **VD)
def _(s, d):
    return outputs_drift(s, d)


@query("pdr2_status", f"{_STATUS} from ({_REPORT}) union all {_STATUS} from ({_REPORT}) where false", "", **VD)
def _(s, d):
    return D.prediction_status(outputs_drift(s, d)).union(D.prediction_status(outputs_drift(s, d, few=True)))


@query("pdr3_rebinned_psi", """
select sum((c - r) * ln(c / r)) as psi from (select r / sum(r) over () as r, c / sum(c) over () as c from (select greatest(coalesce(x.f, 0), 1e-6) as r, greatest(coalesce(y.f, 0), 1e-6) as c from
  (select b, sum(k) / sum(sum(k)) over () as f from (select least(greatest(floor(value * 10 / 250.0), 0), 9) as b, 1 as k from ra where value is not null) group by 1) x full join
  (select b, sum(k) / sum(sum(k)) over () as f from (select least(greatest(floor(((least(greatest(floor(value * 10 / 300.0), 0), 9) + 0.5) * 30.0) * 10 / 250.0), 0), 9) as b, 1 as k from cu where value is not null) group by 1) y using (b)))""", "", "psi", **VD)
def _(s, d):
    r, c = halves(s, d)
    return D.rebinned_psi(D.histogram(r, "value", 0.0, 250.0), D.histogram(c, "value", 0.0, 300.0), 0.0, 250.0, 0.0, 300.0)


@query("pdr4_class_distance", """
select 0.5 * sum(abs(coalesce(x.f, 0) - coalesce(y.f, 0))) as distance from (select event_type, count(*) / sum(count(*)) over () as f from ra group by 1) x full join (select event_type, count(*) / sum(count(*)) over () as f from cu group by 1) y using (event_type)""", "", "distance", **VD)
def _(s, d):
    return D.class_distance(*halves(s, d), "event_type")


@query("pdr4_width_ratio", "select (select quantile_cont(interval_width, 0.5) from b where n_cycles >= 66) / (select quantile_cont(interval_width, 0.5) from b where n_cycles < 66) as ratio", "records", "ratio", **V)
def _(s, d):
    f = fleet(s, d)
    return D.width_ratio(f.filter("n_cycles < 66"), f.filter("n_cycles >= 66"))


# --- performance, alerts, history ----------------------------------------------------

VM = {"m": "select * from predictions join outcomes using (battery_id, cycle_index)"}


def matched(s, d):
    return N.match_outcomes(fixture(s, d, "predictions"), fixture(s, d, "outcomes"))


def _report(name, version, outcomes):
    shown = {"mae": "n_rul >= 20", "rmse": "n_rul >= 20", "bias": "n_rul >= 20", "interval_coverage": "n_rul >= 20", "soh_mae": "n_soh >= 20", "brier": "two", "pr_auc": "two"}
    return f"""select '{name}' as name, case when n_joined = 0 then 'no_labels' when n_joined < 20 then 'insufficient_labels' when contains(breaches, 'degraded') then 'degraded' when breaches <> '' then 'warning' else 'healthy' end as status,
  scope, n_predictions, n_joined, label_coverage, n_rul, {', '.join(shown)}, breaches from (select *, concat_ws(',', case when mae >= 15 then 'life_degraded' when mae >= 5 then 'life_warning' end, case when interval_coverage < 0.85 then 'coverage_warning' end,
    case when soh_mae >= 0.06 then 'health_degraded' when soh_mae >= 0.03 then 'health_warning' end, case when brier >= 0.25 then 'risk_degraded' when brier >= 0.15 then 'risk_warning' end, case when pr_auc < 0.5 then 'ranking_degraded' end) as breaches
  from (with e as (select * from predictions join ({outcomes}) using (battery_id, cycle_index)),
    c as (select (select count(*) from predictions) as n_predictions, count(*) as n_joined, case when count(*) filter (where model_version = '{version}') >= 20 then '{version}' else 'all' end as scope from e),
    r as (select e.*, y_pred - observed_rul as err, soh - observed_soh as serr from e, c where n_joined >= 20 and (scope = 'all' or model_version = scope)),
    m as (select count(err) as n_rul, avg(abs(err)) as mae0, sqrt(avg(err * err)) as rmse0, avg(err) as bias0, avg(case when err is not null then cast(observed_rul between rul_lower_bound and rul_upper_bound as int) end) as interval_coverage0,
      count(serr) as n_soh, avg(abs(serr)) as soh_mae0, avg((probability - eol_within_horizon) ** 2) as brier0, count(probability) >= 20 and min(eol_within_horizon) < max(eol_within_horizon) as two from r),
    s as (select probability, sum(eol_within_horizon) as pos, count(*) as k from r group by 1),
    a as (select sum(pos * tp / tk) / nullif(sum(pos), 0) as pr_auc0 from (select pos, sum(pos) over (order by probability desc) as tp, sum(k) over (order by probability desc) as tk from s))
    select scope, n_predictions, n_joined, coalesce(n_joined / nullif(n_predictions, 0), 0.0) as label_coverage, n_rul, {', '.join(f"case when {c} then {k}0 end as {k}" for k, c in shown.items())} from c, m, a))"""


_REPORTS = {
    "one_version": ("1.1.0", "select * from outcomes"), "unknown_version": ("9.9.9", "select * from outcomes"), "few": ("1.1.0", "select * from outcomes where cast(battery_id as int) = 1 and cycle_index <= 30"),
    "none": ("1.1.0", "select * from outcomes where false"),
    "off": ("1.1.0", "select * replace (observed_rul + 30 as observed_rul, observed_soh - 0.05 as observed_soh, 1 - eol_within_horizon as eol_within_horizon) from outcomes"),
}
_PRF_DOUBLES = "label_coverage mae rmse bias interval_coverage soh_mae brier pr_auc"


def report(s, d, name, version):
    o, p = fixture(s, d, "outcomes"), fixture(s, d, "predictions")
    if name == "few":
        o = o.filter("battery_id = '1' AND cycle_index <= 30")
    elif name == "none":
        o = o.filter("false")
    elif name == "off":
        o = o.withColumns({"observed_rul": F.col("observed_rul") + 30, "observed_soh": F.col("observed_soh") - 0.05, "eol_within_horizon": 1 - F.col("eol_within_horizon")})
    return N.performance_report(p, o, version)


@query("prf1_performance_report", " union all ".join(_report(k, *v) for k, v in _REPORTS.items()), "predictions outcomes", _PRF_DOUBLES)
def _(s, d):
    out = [report(s, d, k, v).select(F.lit(k).alias("name"), "*") for k, (v, _) in _REPORTS.items()]
    return reduce(lambda a, b: a.union(b), out)


@query("prf2_error_by_life", """
select t.band, t.low, count(a) as n, avg(a) as mean_error from (values (0, 0.0::double), (1, 20.0::double), (2, 50.0::double), (3, 100.0::double)) t(band, low) left join (
  select abs(y_pred - observed_rul) as a, case when observed_rul < 20 then 0 when observed_rul < 50 then 1 when observed_rul < 100 then 2 else 3 end as band from m where observed_rul >= 0) q using (band) group by 1, 2""", "predictions outcomes", "low mean_error", **VM)
def _(s, d):
    return N.error_by_life(matched(s, d))


@query("prf3_issued_coverage", "select count(*) as n, avg(cast(observed_rul between rul_lower_bound and rul_upper_bound as int)) as coverage, avg(rul_upper_bound - rul_lower_bound) as width from m", "predictions outcomes", "coverage width", **VM)
def _(s, d):
    return N.issued_coverage(matched(s, d))


@query("prf4_label_delay", "select quantile_cont(observed_at_cycle - cycle_index, 0.5) as median, avg(observed_at_cycle - cycle_index) as mean, min(observed_at_cycle - cycle_index) as least, max(observed_at_cycle - cycle_index) as most from m", "predictions outcomes", "median mean", **VM)
def _(s, d):
    return N.label_delay(matched(s, d))


_ALERT = "'alert-' || substr(sha256(concat_ws('|', alert_type, 'fleet', 'batch', k)), 1, 16)"
_TOLD = """printf('%d good, %d acceptable, %d poor, %d insufficient', n_good, n_acceptable, n_poor, n_insufficient)"""
VA = {
    **V, **VF, "fq": _FQ, "pr": _report("off", *_REPORTS["off"]),
    "pd": f"{_STATUS} from ({_REPORT})",
    "ct": "select count(*) as n, count(*) filter (where status = 'failed') as failed, count(*) filter (where priority = 'P0') as critical from p",
    "a": f"""select alert_type, severity, evidence, observed, threshold, action, {_ALERT} as alert_id from (
  select 'data_quality_' || status as alert_type, status as severity, {_TOLD} as evidence, poor_fraction as observed, case status when 'critical' then 0.25 else 0.1 end::double as threshold, '{N._ACTS['data_quality']}' as action, 'quality' as k from fq where status in ('warning', 'critical') union all
  select 'scoring_failures', case when failed > n / 2 then 'critical' else 'warning' end, printf('%d of %d entities failed', failed, n), failed, null, '{N._ACTS['scoring_failures']}', 'failures' from ct where failed > 0 union all
  select 'critical_entities', 'warning', printf('%d entities are P0', critical), critical, 5.0, '{N._ACTS['critical_entities']}', 'critical_count' from ct where critical >= 5 union all
  select 'feature_drift_' || status, status, printf('%d of %d features drifted', n_drifted, n), fraction, case status when 'critical' then 0.25 else 0.1 end, '{N._ACTS['feature_drift']}', 'feature_drift' from fl where status in ('warning', 'critical') union all
  select 'prediction_drift', status, printf('%d outputs drifted', n_drifted), n_drifted, null, '{N._ACTS['prediction_drift']}', 'prediction_drift' from pd where status in ('warning', 'critical') union all
  select 'performance_' || status, case status when 'degraded' then 'critical' else 'warning' end, breaches, null, null, '{N._ACTS['performance']}', 'performance' from pr where status in ('degraded', 'warning') union all
  select 'model_unavailable', 'critical', 'no model', null, null, '{N._ACTS['model_unavailable']}', 'readiness' from ct where failed > 0)""",
}


def alerts(s, d, muted=()):
    f = fleet(s, d)
    shift = D.prediction_status(outputs_drift(s, d))
    ready = f.agg((F.count_if(F.col("status") == "failed") == 0).alias("ready")).withColumn("errors", F.lit("no model"))
    return N.fleet_alerts("fleet", "batch", fleet_quality(s, d), f, fleet_drift(s, d), shift, report(s, d, "off", "1.1.0"), ready, muted=muted)


@query("alr1_fleet_alerts", "select * from a", "records arrivals predictions outcomes", "observed threshold", **VA)
def _(s, d):
    return alerts(s, d)


@query("alr1_muted", "select alert_type from a where alert_type not in ('critical_entities', 'prediction_drift')", "records arrivals predictions outcomes", **VA)
def _(s, d):
    return alerts(s, d, ("critical_entities", "prediction_drift")).select("alert_type")


@query("alr2_alert_id", "select battery_id, 'alert-' || substr(sha256(concat_ws('|', 'low_soh', 'fleet', 'batch', battery_id)), 1, 16) as alert_id from records", "records")
def _(s, d):
    return fixture(s, d, "records").select("battery_id", N.alert_id(F.lit("low_soh"), F.lit("fleet"), F.lit("batch"), F.col("battery_id")).alias("alert_id"))


@query("mon1_worst_status", "select arg_max(status, case status when 'ok' then 0 when 'unknown' then 1 when 'warning' then 2 else 3 end) as status from (select case when measured_soh <= 0.65 then 'warning' else 'ok' end as status from records)", "records")
def _(s, d):
    return N.worst_status(fixture(s, d, "records").select(F.when(F.col("measured_soh") <= 0.65, "warning").otherwise("ok").alias("status")))


@query("mon2_fingerprint")
def _(s, d):
    return N.fingerprint(cycles(s, d), ["battery_id", "cycle_index", "capacity_ah"])


@query("mon3_alert_summary", "select severity, count(*) as n, string_agg(distinct alert_type, ',' order by alert_type) as types, (select count(*) from a) as total from a group by 1", "records arrivals predictions outcomes", **VA)
def _(s, d):
    return N.alert_summary(alerts(s, d))


_SNAP = "select event_type as fleet_id, cast(cast(ts as date) as string) as day, count(*) as n, max(event_id) as last_event from events group by 1, 2"


def snaps(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("fleet_id"), F.col("ts").cast("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


@query("his1_latest_snapshot", f"select * from ({_SNAP}) qualify row_number() over (partition by fleet_id order by day desc) = 1")
def _(s, d):
    return N.latest_by(snaps(s, d), ["fleet_id"], [F.desc("day")])


@query("ref6_adopt_latest", f"select avg(n) as mean_n, cast(sum(last_event) as bigint) as total from ({_SNAP} qualify row_number() over (partition by event_type order by cast(ts as date) desc) = 1)".replace(" qualify", ") qualify").replace("from (select event_type", "from (select * from (select event_type").replace("partition by event_type order by cast(ts as date) desc", "partition by fleet_id order by day desc"), "", "mean_n")
def _(s, d):
    return N.latest_by(snaps(s, d), ["fleet_id"], [F.desc("day")]).agg(F.avg("n").alias("mean_n"), F.sum("last_event").alias("total"))


@query("his2_listing", f"select * from ({_SNAP}) where n >= 5 order by day desc, fleet_id limit 25")
def _(s, d):
    return N.listing(snaps(s, d), F.col("n") >= 5, [F.desc("day"), F.asc("fleet_id")], 25)


@query("his3_insert_or_ignore", f"select fleet_id, day, case when n % 2 = 0 then n else -n end as n from ({_SNAP})")
def _(s, d):
    x = snaps(s, d).select("fleet_id", "day", "n")
    return N.insert_or_ignore(x.filter("n % 2 = 0"), x.withColumn("n", -F.col("n")), ["fleet_id", "day"])


@query("his4_insert_or_replace", f"select fleet_id, day, case when n % 2 = 0 then -n else n end as n from ({_SNAP})")
def _(s, d):
    x = snaps(s, d).select("fleet_id", "day", "n")
    return N.insert_or_replace(x, x.filter("n % 2 = 0").withColumn("n", -F.col("n")), ["fleet_id", "day"], [F.asc("n")])


@query("his5_acknowledge", "select battery_id, failure_risk > 0.5 is true or status = 'failed' as acknowledged from records", "records")
def _(s, d):
    r = fixture(s, d, "records").withColumn("acknowledged", F.col("status") == "failed")
    return N.acknowledge(r, F.col("failure_risk") > 0.5).select("battery_id", "acknowledged")


@query("his6_prune", f"select * from ({_SNAP}) where day >= '2024-01-16'")
def _(s, d):
    return N.prune(snaps(s, d), "day", F.lit("2024-01-16"))


_KEPT = f"""select fleet_id, day, case when day >= '2024-01-20' then -n else n end as n, day >= '2024-01-20' and fleet_id = 'click' as acknowledged from ({_SNAP}) where day >= '2024-01-16'"""


@query("his3_stored_table", f"{_KEPT} union all select 'new', '2024-03-01', 1, false")
def _(s, d):
    """Snapshots are stored by day, re-inserted, replaced, acknowledged and pruned in place, then read back."""
    x = snaps(s, d).select("fleet_id", "day", "n").withColumn("acknowledged", F.lit(False))
    t = StoredTable(s, shared_folder(s, "snapshots"), "fleet_id string, day string, n long, acknowledged boolean", ["fleet_id", "day"], "day")
    t.append_new(x)
    late = s.createDataFrame([("new", "2024-03-01", 1, False)], x.schema)
    t.append_new(x.withColumn("n", F.lit(0).cast("long")).unionByName(late))
    t.replace(x.filter("day >= '2024-01-20'").withColumn("n", -F.col("n")))
    t.update((F.col("fleet_id") == "click") & F.col("day").between("2024-01-20", "2024-02-28"), {"acknowledged": F.lit(True)})
    t.prune("2024-01-16")
    return t.read()


@query("his7_prediction_records", "select concat_ws(':', 'snap', battery_id, latest_cycle) as prediction_id, battery_id, latest_cycle as cycle_index, predicted_rul, rul_lower_bound, rul_upper_bound from records where status = 'success' and predicted_rul is not null", "records", "predicted_rul rul_lower_bound rul_upper_bound")
def _(s, d):
    return N.prediction_records(fixture(s, d, "records"), "snap")
