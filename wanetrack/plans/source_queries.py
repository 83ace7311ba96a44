"""Queries for sources and sinks. What they read back was written by Spark from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wanetrack.operators import fleet as L
from wanetrack.plans.book import query
from wanetrack.plans.fixtures import fixture, table
from wanetrack.sources import tables as R

_EV = "select event_id, user_id, event_type, value from events"
_SCHEMA = "event_id long, user_id long, event_type string, value double"


def events(s, d):
    return table(s, d, "events").select(F.col("event_id").cast("long"), F.col("user_id").cast("long"), "event_type", "value")


@query("src1_read_csv", _EV, "", "value")
def _(s, d):
    path = R.shared_folder(s, "events") + ".csv"
    R.write_table(events(s, d), path)
    return R.read_table(s, path, _SCHEMA)


@query("src1_read_parquet", _EV, "", "value")
def _(s, d):
    return R.read_table(s, f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value")


@query("src2_read_json", _EV, "", "value")
def _(s, d):
    path = R.shared_folder(s, "events") + ".jsonl"
    events(s, d).write.json(path)
    return R.read_table(s, path, _SCHEMA)


@query("src2_read_json_array", _EV, "", "value")
def _(s, d):
    """Files that each hold one array of records."""
    path = R.shared_folder(s, "events") + ".json"
    e = events(s, d)
    arrays = e.groupBy(F.floor(F.col("event_id") / 5000).alias("part")).agg(F.to_json(F.collect_list(F.struct(*e.columns))).alias("value"))  # 5000 records each
    arrays.write.partitionBy("part").text(path)
    return R.read_table(s, path, _SCHEMA).drop("part")


@query("src3_entity_files", "select cast(user_id as string) as battery_id, count(*) as n, sum(value) as total from events group by 1", "", "total")
def _(s, d):
    path, nobody = R.shared_folder(s, "entities"), F.lit("nobody")  # stands for a null id, which no file is named after
    e = events(s, d).select(F.coalesce(F.col("user_id").cast("string"), nobody).alias("battery_id"), "event_id", "value")
    R.write_entity_files(e, path)
    good, _ = R.read_entity_files(s, path, "battery_id string, event_id long, value double")
    return good.groupBy(F.nullif("battery_id", nobody).alias("battery_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("src5_coerce_schema", """
select battery_id, cycle_index, capacity_ah, temperature_max_c, cast(null as double) as rectified_impedance_ohm, event_type from cycles""", "cycles", "capacity_ah temperature_max_c")
def _(s, d):
    return R.coerce_schema(fixture(s, d, "cycles")).select("battery_id", "cycle_index", "capacity_ah", "temperature_max_c", "rectified_impedance_ohm", "event_type")


@query("src6_drop_labels", "select battery_id, predicted_rul, status from records", "records", "predicted_rul")
def _(s, d):
    labels = {"eol_cycle": F.lit(1), "is_censored": F.lit(True), "life_fraction": F.lit(0.5), "rul_cycles": F.lit(3), "fails_in_30": F.lit(0)}
    return R.drop_labels(fixture(s, d, "records").select("battery_id", "predicted_rul", "status").withColumns(labels))


@query("snk1_write_table", "select battery_id, cycle_index, case when cast(battery_id as int) % 3 = 0 then 'test' else 'train' end as split from cycles", "cycles")
def _(s, d):
    path = R.shared_folder(s, "splits")
    c = fixture(s, d, "cycles").select("battery_id", "cycle_index", F.when(F.col("battery_id").cast("int") % 3 == 0, "test").otherwise("train").alias("split"))
    R.write_table(c, path, ["split"])
    return s.read.schema("battery_id string, cycle_index int, split string").parquet(path)


@query("snk2_result_tables", "select battery_id, status, case when measured_soh is null then 'unknown' when measured_soh >= 0.9 then 'healthy' when measured_soh >= 0.8 then 'slightly_degraded' when measured_soh >= 0.7 then 'warning' else 'critical' end as health_class from records", "records")
def _(s, d):
    path = R.shared_folder(s, "ranking")
    R.write_table(L.with_derived(fixture(s, d, "records")).select("battery_id", "status", "health_class"), path)
    return R.read_table(s, path)
