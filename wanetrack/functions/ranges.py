"""Running sums over a whole table's order without a single task that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanetrack.sources.tables import written


def in_ranges(df: DataFrame, *order: Column, ranges: int | None = None) -> DataFrame:
    """df, written once, with `_range`: later rows of that order have the same number or larger ones, and `_tie`, a number of its own a row.

    Rows that are equal in `order` are ordered by `_tie`, so one value that most rows have
    spreads over as many ranges as others do.
    """
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    cut = (*order, F.col("_tie"))
    laid = rows.repartitionByRange(ranges, *cut) if ranges else rows.repartitionByRange(*cut)
    return written(laid.withColumn("_range", F.spark_partition_id()), "ranges")


def running(
    df: DataFrame, order: str, sums: dict[str, Column], by: Sequence[str] = (), descending: bool = False, ties: Sequence[str] = (),
    totals: bool = False, following: str | None = None, ranges: int | None = None,
) -> DataFrame:
    """df with a column for each of `sums`: its sum over all rows before, in the order of `order` and `ties`, and this one.

    The rows are written once, in ranges of that order, and sorted within them; the ranges'
    totals, a few numbers each, are added up and handed back. Null values of `order` are
    left out. Rows that tie in all columns are taken one by one in no fixed order, so what
    counts them should sum equal numbers. With `totals`, columns `total_<name>` hold the
    sums over all rows of the group; with `following`, that column holds the next row's
    value of `order`, null at a group's last.
    """
    turn = lambda c: F.desc(c) if descending else F.asc(c)
    summed = df.filter(F.col(order).isNotNull()).withColumns({f"_s_{k}": c for k, c in sums.items()})
    rows = in_ranges(summed, *map(F.col, by), turn(order), *map(F.col, ties), ranges=ranges)
    first = (F.max if descending else F.min)(order)
    parts = rows.groupBy(*by, "_range").agg(first.alias("_first"), *[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    inner = Window.partitionBy(*by).orderBy("_range")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_r"), F.lead("_first").over(inner).alias("_next"),
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums],
        *[F.sum(f"_t_{k}").over(Window.partitionBy(*by)).alias(f"total_{k}") for k in sums],
    )
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy(*by, "_range").orderBy(turn(order), *ties, "_tie")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(bases) if not by else bases, same)  # without groups: one row a range
    added = {k: F.col(f"_b_{k}") + F.sum(f"_s_{k}").over(upto) for k in sums}
    if following:
        added[following] = F.coalesce(F.lead(order).over(inside), F.col("_next"))
    out = out.withColumns(added)
    return out.select(*df.columns, *added, *([f"total_{k}" for k in sums] if totals else []))
