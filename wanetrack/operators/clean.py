"""Cleaning of asset histories: order-aware rules, ranges, gates and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanetrack.functions.exprs import BEFORE, finite, first_run, history, median, whole

ID, ORDER, VALUE = "battery_id", "cycle_index", "capacity_ah"


def keep_entities(
    df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), min_rows: int = 0, entity: str = ID
) -> DataFrame:
    """SRC4: allow list, deny list, then entities with enough rows."""
    if include:
        df = df.filter(F.col(entity).isin(*include))
    if exclude:
        df = df.filter(~F.col(entity).isin(*exclude))
    if min_rows:
        df = df.withColumn("_n", F.count(F.lit(1)).over(whole(entity))).filter(F.col("_n") >= min_rows).drop("_n")
    return df


def truncate_collapse(
    df: DataFrame, value: str = VALUE, first: int = 10, fraction: float = 0.25, persistence: int = 5,
    entity: str = ID, order: str = ORDER,
) -> DataFrame:
    """CLN1: drops rows from the first run of `persistence` rows below a part of the early median."""
    w = history(entity, order)
    df = df.withColumn("_rn", F.row_number().over(w))
    df = df.withColumn("_ref", median(F.when(F.col("_rn") <= first, F.col(value))).over(whole(entity)))
    start = first_run(F.col(value) < fraction * F.col("_ref"), order, entity, persistence)
    df = df.withColumn("_start", start).withColumn("_cut", F.min("_start").over(whole(entity)))
    return df.filter(F.col("_cut").isNull() | (F.col(order) < F.col("_cut"))).drop("_rn", "_ref", "_start", "_cut")


def trim_leading(
    df: DataFrame, value: str = VALUE, fraction: float = 0.9, lookahead: int = 10, entity: str = ID, order: str = ORDER
) -> DataFrame:
    """CLN2: drops the prefix of rows below a part of the median of the next rows; numbers the rest from 1."""
    w = history(entity, order)
    ahead = median(value).over(w.rowsBetween(1, lookahead))
    df = df.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(whole(entity)))
    bad = (F.col("_rn") <= F.col("_n") - lookahead) & (F.col(value) < fraction * ahead)
    df = df.withColumn("_bad", F.coalesce(bad, F.lit(False)).cast("int"))
    df = df.withColumn("_lead", F.min("_bad").over(w.rowsBetween(BEFORE, 0))).filter("_lead = 0")
    return df.withColumn(order, F.row_number().over(w)).drop("_rn", "_n", "_bad", "_lead")


def dedupe_first(df: DataFrame, keys: Sequence[str], tie: Sequence[str | Column]) -> DataFrame:
    """CLN3: one row a key, the first by `tie`."""
    w = Window.partitionBy(*keys).orderBy(*tie)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def null_out_of_range(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """CLN4: values outside their column's range become null. ranges: suffix ('_v') or column name to bounds."""
    out = {}
    for c in df.columns:
        for key, (lo, hi) in ranges.items():
            if c == key or (key.startswith("_") and c.endswith(key)):
                out[c] = F.when(finite(c).between(lo, hi), F.col(c))
    return df.withColumns(out)


def out_of_range_counts(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """CLN4: (column, n) of values that null_out_of_range clears."""
    named = {c: b for c in df.columns for k, b in ranges.items() if c == k or (k.startswith("_") and c.endswith(k))}
    agg = df.agg(*[F.count_if(~F.col(c).between(*b)).alias(c) for c, b in named.items()])
    return agg.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in named])))


def drop_jumps(df: DataFrame, value: str = VALUE, limit: float = 0.7, entity: str = ID, order: str = ORDER) -> DataFrame:
    """CLN5: drops null and non-positive values, then in one pass rows that jump against the row before."""
    df = df.filter(finite(value) > 0)
    step = F.abs(F.col(value) - F.lag(value).over(history(entity, order)))
    return df.withColumn("_step", step).filter(F.coalesce(F.col("_step") <= limit, F.lit(True))).drop("_step")


def missing_fractions(df: DataFrame, columns: Sequence[str], budget: float = 0.05) -> DataFrame:
    """CLN6: (column, fraction missing, over budget), from one pass."""
    agg = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns])
    return agg.select(F.inline(rows)).withColumn("over_budget", F.col("missing") > budget)


def impute_forward(df: DataFrame, columns: Sequence[str], entity: str = ID, order: str = ORDER) -> DataFrame:
    """CLN7: last known value within the entity, and <column>_is_missing flags."""
    w = history(entity, order).rowsBetween(BEFORE, 0)
    flags = {f"{c}_is_missing": F.col(c).isNull().cast("int") for c in columns}
    return df.withColumns(flags).withColumns({c: F.last(c, True).over(w) for c in columns})


def order_violations(df: DataFrame, arrival: str, entity: str = ID, order: str = ORDER) -> DataFrame:
    """CLN9: (entity, ordered): whether the order key rises along the arrival order."""
    step = F.col(order) > F.lag(order).over(Window.partitionBy(entity).orderBy(arrival))
    return df.withColumn("_up", F.coalesce(step, F.lit(True))).groupBy(entity).agg(F.bool_and("_up").alias("ordered"))


def cohort_gates(
    df: DataFrame, value: str = VALUE, nominal: float = 2.0, min_start: float = 0.8, min_fade: float = 0.02,
    entity: str = ID, order: str = ORDER,
) -> DataFrame:
    """CLN10: per entity its start, its fade and why it is rejected (null: accepted)."""
    g = df.groupBy(entity).agg(
        (F.min_by(value, order) / nominal).alias("start_soh"),
        ((F.min_by(value, order) - F.min(value)) / nominal).alias("fade"),
    )
    reason = F.when(F.col("start_soh") < min_start, "low_start").when(F.col("fade") < min_fade, "no_fade")
    return g.withColumn("reason", reason)


def accepted(df: DataFrame, gates: DataFrame, entity: str = ID) -> DataFrame:
    return df.join(gates.filter("reason is null").select(entity), entity, "left_semi")


#: Fixed values of the surveyed validation policy.
VOLTS, DEGREES, MISSING_BUDGET, MAX_JUMP, LEAST_CYCLES = (0.0, 5.0), (-40.0, 100.0), 0.05, 0.35, 30


def validation_report(
    df: DataFrame, arrival: str | None = None, nominal: float = 2.0, min_rows: int = LEAST_CYCLES, entity: str = ID, order: str = ORDER, value: str = VALUE
) -> DataFrame:
    """CLN11: one row a check with severity, rows (columns for missing_budget), and the number of entities it concerns.

    Bounds are checked of all columns that end in _v and _c; arrival is the order in which
    rows came. An empty table gives the rows with zeros and the finding empty_table.
    """
    kinds = dict(df.dtypes)
    numbers = [c for c, k in kinds.items() if k in ("double", "float", "int", "bigint", "smallint") and c not in (order, arrival)]
    out = F.lit(False)
    for suffix, (low, high) in (("_v", VOLTS), ("_c", DEGREES)):
        for c in (c for c in numbers if c.endswith(suffix)):
            out = out | F.coalesce(~F.col(c).between(low, high), F.lit(False))
    w, no = history(entity, order), F.lit(False)
    nth = F.row_number().over(Window.partitionBy(entity, order).orderBy(arrival or order))
    back = F.col(order) < F.lag(order).over(Window.partitionBy(entity).orderBy(arrival)) if arrival else no
    checks = [
        ("duplicate_key", "warning", nth > 1), ("ordering", "error", back), ("out_of_bounds", "warning", out), ("missing_value", "warning", finite(value).isNull()),
        ("non_positive_value", "warning", F.col(value) <= 0), ("jump", "warning", F.abs(F.col(value) - F.lag(value).over(w)) > MAX_JUMP * nominal),
        ("short_history", "warning", F.count(F.lit(1)).over(Window.partitionBy(entity)) < min_rows),
    ]
    marked = df.select(entity, *numbers, *[F.coalesce(c, no).alias(f"_{n}") for n, _, c in checks])
    over = sum(((F.avg(F.col(c).isNull().cast("int")) > MISSING_BUDGET).cast("int") for c in numbers), F.lit(0))
    agg = marked.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(over, F.lit(0)).cast("bigint").alias("missing_budget"), *[F.count_if(F.col(f"_{n}")).alias(n) for n, _, _ in checks],
        *[F.count_distinct(F.when(F.col(f"_{n}"), F.col(entity))).alias(f"{n}_e") for n, _, _ in checks],
    )
    row = lambda n, s, rows, e: F.struct(F.lit(n).alias("check_name"), F.lit(s).alias("severity"), rows.cast("bigint").alias("n_rows"), e.cast("bigint").alias("n_entities"))
    rows = [row("empty_table", "error", (F.col("n") == 0).cast("int"), F.lit(0)), row("missing_budget", "warning", F.col("missing_budget"), F.lit(0))]
    return agg.select(F.inline(F.array(*rows, *[row(n, s, F.col(n), F.col(f"{n}_e")) for n, s, _ in checks])))


def ingest(
    df: DataFrame, min_rows: int = 2, max_rows: int = 5000, max_gap: int = 25, limit: int = 10_000, arrival: str = "event_id",
    value: str = VALUE, entity: str = ID, order: str = ORDER,
) -> DataFrame:
    """CLN12: per entity its errors, warnings and status; a bad entity never fails the others."""
    step = F.col(order) - F.lag(order).over(history(entity, order))
    unsorted = F.col(order) < F.lag(order).over(Window.partitionBy(entity).orderBy(arrival))
    g = (
        df.withColumn("_gap", step).withColumn("_back", unsorted)
        .groupBy(entity)
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col(order).isNull()).alias("no_order"),
            F.min(order).alias("least"), F.count_distinct(order).alias("orders"), F.count(finite(value)).alias("values"),
            F.max("_gap").alias("gap"), F.coalesce(F.bool_or("_back"), F.lit(False)).alias("back"),
        )
        .withColumn("place", F.row_number().over(Window.orderBy(entity)))
    )
    name = F.col(entity)
    errors = {
        "blank_id": F.trim(name) == "", "path_like_id": name.rlike(r"[/\\]|\.\."), "long_id": F.length(name) > 64,
        "missing_order": F.col("no_order") > 0, "negative_order": F.col("least") < 0,
        "duplicate_order": F.col("orders") < F.col("n") - F.col("no_order"), "no_values": F.col("values") == 0,
        "too_few_rows": F.col("n") < min_rows, "too_many_rows": F.col("n") > max_rows, "over_batch_limit": F.col("place") > limit,
    }
    warnings = {
        "unsorted": F.col("back"), "gap": F.col("gap") > max_gap, "missing_values": F.col("values") < F.col("n"),
    }
    listed = lambda m: F.concat_ws(",", *[F.when(c, F.lit(k)) for k, c in m.items()])
    out = g.select(entity, "n", listed(errors).alias("errors"), listed(warnings).alias("warnings"))
    return out.withColumn("status", F.when(F.col("errors") == "", "accepted").otherwise("failed"))
