"""Rare features stay rare, however large the tables are."""

from pyspark.sql import functions as F

from wanetrack.plans import fleet_queries as Q


def test_rare_features_are_small_samples_in_larger_tables(spark, tmp_path):
    """Of 80 ids that 500 divides, 40 lie in the batch, more than the 30 rows that a test asks for."""
    ts = F.when(F.col("id") % 1000 == 0, F.expr("timestamp_ntz '2024-01-01'")).otherwise(F.expr("timestamp_ntz '2024-02-01'"))
    kind = F.element_at(F.array(*map(F.lit, ("click", "view", "signup"))), (F.col("id") % 3 + 1).cast("int"))
    events = spark.range(0, 500 * 80, 20).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), ts.alias("ts"), kind.alias("event_type"), (F.col("id") % 97).cast("double").alias("value"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    kinds = {r.feature: r.metric for r in Q.drifting(spark, str(tmp_path)).filter("feature IN ('rare', 'seldom')").collect()}
    assert kinds == {"rare": "small_sample", "seldom": "small_sample"}
