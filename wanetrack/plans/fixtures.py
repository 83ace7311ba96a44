"""Histories derived from the driver's tables, as SQL that Spark and DuckDB both run.

Every text reads `events`; CYCLES and the others stand in for tables of assets that age.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CYCLES = """
with base as (
  select user_id, event_id, ts, event_type, value,
         row_number() over (partition by user_id order by ts, event_id) as k,
         count(*) over (partition by user_id) as n
  from events)
select cast(user_id as string) as battery_id, user_id, event_id, ts, event_type, value,
  cast(k as int) as cycle_index, cast(n as int) as n_cycles,
  case when user_id % 11 = 0 and k <= 2 then cast(0.3 as double)
       when user_id % 13 = 0 and k > n - 8 then cast(0.1 as double)
       else cast(2.0 as double)
          - (case when user_id % 7 = 0 then cast(0.3 as double) else cast(0.8 as double) end)
            * cast(k as double) / cast(n as double)
          + cast(0.002 as double) * least(value, cast(50.0 as double)) end as capacity_ah,
  cast(2.5 as double) + value / cast(1000.0 as double) as voltage_min_v,
  cast(24.0 as double) as ambient_temperature_c,
  cast(24.0 as double) + cast(0.3 as double) * value as temperature_max_c,
  case when event_type = 'error' then null
       else cast(0.05 as double) + cast(0.0005 as double) * cast(k as double)
  end as internal_resistance_ohm,
  cast(3600.0 as double) + value as discharge_duration_s,
  cast(9000.0 as double) - value as charge_duration_s,
  cast(6.5 as double) + value / cast(100.0 as double) as energy_throughput_wh
from base
"""

SAMPLES = """
with base as (
  select user_id, event_id, ts, event_type, value,
         row_number() over (partition by user_id order by ts, event_id) - 1 as j
  from events)
select cast(user_id as string) as battery_id,
  cast(floor(j / cast(8 as double)) as int) as step_no,
  case cast(floor(j / cast(8 as double)) as int) % 3
    when 0 then 'charge' when 1 then 'discharge' else 'impedance' end as step_type,
  cast(60.0 as double) * cast(j % 8 as double) as time_s,
  cast(4.2 as double) - cast(0.1 as double) * cast(j % 8 as double)
    + value / cast(500.0 as double) as voltage,
  cast(-2.0 as double) + value / cast(1000.0 as double) as current_a,
  cast(20.0 as double) + value / cast(20.0 as double) as temperature
from base
"""

PREDICTIONS = """
with base as (
  select user_id, event_id, event_type, value,
         row_number() over (partition by user_id order by ts, event_id) as k,
         count(*) over (partition by user_id) as n
  from events)
select cast(event_id as string) as prediction_id, cast(user_id as string) as battery_id,
  cast(k as int) as cycle_index, event_type as model,
  case when user_id % 2 = 0 then '1.0.0' else '1.1.0' end as model_version,
  cast(n - k as double) as y_true,
  case when k <= 5 then null
       else cast(n - k as double) + (value - cast(50.0 as double)) / cast(10.0 as double)
  end as y_pred,
  cast(n - k as double) + (value - cast(50.0 as double)) / cast(10.0 as double)
    - cast(8.0 as double) as rul_lower_bound,
  cast(n - k as double) + (value - cast(50.0 as double)) / cast(10.0 as double)
    + cast(8.0 as double) as rul_upper_bound,
  cast(1.0 as double) - cast(0.4 as double) * cast(k as double) / cast(n as double) as soh,
  value / (value + cast(50.0 as double)) as probability,
  case when n - k <= 20 then 1 else 0 end as label
from base
"""

OUTCOMES = """
with base as (
  select user_id, event_id, value,
         row_number() over (partition by user_id order by ts, event_id) as k,
         count(*) over (partition by user_id) as n
  from events)
select cast(user_id as string) as battery_id, cast(k as int) as cycle_index,
  cast(k + event_id % 40 as int) as observed_at_cycle,
  cast(n - k as double) as observed_rul,
  cast(1.0 as double) - cast(0.4 as double) * cast(k as double) / cast(n as double)
    as observed_soh,
  case when n - k <= 30 then 1 else 0 end as eol_within_horizon
from base where event_id % 3 = 0
"""

RECORDS = """
with base as (
  select user_id, count(*) as n, avg(value) as av, max(value) as mx, min(value) as mn
  from events group by user_id)
select cast(user_id as string) as battery_id,
  case when user_id % 17 = 0 then 'failed' when user_id % 19 = 0 then 'insufficient_data'
       else 'success' end as status,
  cast(n as int) as n_cycles, cast(n as int) as latest_cycle,
  cast(0.60 as double) + cast(user_id % 40 as double) / cast(100.0 as double) as measured_soh,
  case when user_id % 23 = 0 then null else cast(user_id % 120 as double) end as predicted_rul,
  case when user_id % 23 = 0 or user_id % 5 = 0 then null
       else greatest(cast(user_id % 120 as double) - av / cast(5.0 as double),
                     cast(0.0 as double)) end as rul_lower_bound,
  case when user_id % 23 = 0 or user_id % 5 = 0 then null
       else cast(user_id % 120 as double) + mx / cast(10.0 as double) end as rul_upper_bound,
  case when user_id % 9 = 0 then null
       else cast(user_id % 100 as double) / cast(100.0 as double) end as failure_risk,
  user_id % 10 = 0 as risk_is_experimental,
  case when user_id % 8 = 0 then null
       else cast(user_id % 30 as double) / cast(10.0 as double) - cast(1.0 as double)
  end as fade_trend_pct_per_10,
  cast(1.0 as double) - cast(user_id % 12 as double) / cast(15.0 as double)
    as data_quality_score,
  cast(user_id % 4 as int) as out_of_distribution_feature_count,
  case when user_id % 6 = 0 then null
       else cast(0.4 as double) - cast(user_id % 25 as double) / cast(10.0 as double)
  end as soh_trend_pct_per_10,
  case when user_id % 7 = 0 then null
       else cast(user_id % 16 as double) / cast(10.0 as double) - cast(0.8 as double)
  end as temperature_trend_c_per_10,
  case when user_id % 10 = 3 then null
       else cast(user_id % 36 as double) / cast(10.0 as double) - cast(0.5 as double)
  end as resistance_trend_pct_per_10,
  user_id % 47 = 0 as critical_data_warning
from base
"""

#: Cycle rows as they arrive, with the faults that a quality check looks for.
ARRIVALS = """
with base as (
  select user_id, event_id, value,
         row_number() over (partition by user_id order by ts, event_id) as k
  from events)
select cast(user_id as string) as battery_id, event_id as arrival,
  cast(case when user_id % 29 = 0 and k = 3 then 2
            when user_id % 3 = 0 then k
            else row_number() over (partition by user_id order by event_id) end as int) as cycle_index,
  case when user_id % 43 = 0 and k = 5 then cast(4.5 as double)
       when user_id % 53 = 0 and k = 6 then cast(0.0 as double)
       else cast(2.0 as double) - cast(k as double) / cast(200.0 as double) end as capacity_ah,
  case when user_id % 31 = 0 and k = 7 then cast(6.0 as double)
       else cast(3.0 as double) + value / cast(1000.0 as double) end as voltage_mean_v,
  case when user_id % 41 = 0 then null
       when user_id % 37 = 0 and k = 9 then cast(120.0 as double)
       else cast(24.0 as double) + cast(0.3 as double) * value end as temperature_max_c,
  case when user_id % 6 = 0 or user_id % 41 = 0 then null
       else cast(0.05 as double) + cast(0.0005 as double) * cast(k as double) end as internal_resistance_ohm
from base
where not (user_id % 5 = 0 and k between 20 and 48)
  and not (user_id % 23 = 1 and k > 9) and not (user_id % 19 = 2 and k > 30)
"""

ALL = {"cycles": CYCLES, "samples": SAMPLES, "predictions": PREDICTIONS, "outcomes": OUTCOMES, "records": RECORDS, "arrivals": ARRIVALS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(ALL[name].replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))


def oracle(body: str, *names: str, **views: str) -> str:
    """A query over the named fixtures and further views, as one DuckDB statement."""
    parts = [f"{n} as ({ALL[n]})" for n in names] + [f"{k} as ({v})" for k, v in views.items()]
    return f"with {', '.join(parts)}\n{body}" if parts else body
