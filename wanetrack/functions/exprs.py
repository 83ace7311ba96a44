"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

BEFORE, AFTER = Window.unboundedPreceding, Window.unboundedFollowing


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def history(entity: str, order: str) -> WindowSpec:
    """One window specification for all order-aware operators of an entity, so that Spark sorts once."""
    return Window.partitionBy(entity).orderBy(order)


def trailing(entity: str, order: str, rows: int) -> WindowSpec:
    return history(entity, order).rowsBetween(-(rows - 1), 0)


def whole(entity: str) -> WindowSpec:
    return Window.partitionBy(entity)


def median(c: str | Column) -> Column:
    """An exact interpolated median that also works in window frames."""
    return F.percentile(col(c), F.lit(0.5))


def finite(c: str | Column) -> Column:
    """NaN and infinities become null; comparisons then never meet them."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def ladder(*steps: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    out = F.when(steps[0][0], F.lit(steps[0][1]))
    for cond, value in steps[1:]:
        out = out.when(cond, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def clip(c: str | Column, low: float | None, high: float | None) -> Column:
    x = col(c)
    if low is not None:
        x = F.when(x.isNotNull(), F.greatest(x, F.lit(low)))
    if high is not None:
        x = F.when(x.isNotNull(), F.least(x, F.lit(high)))
    return x


def first_run(flag: Column, order: str, entity: str, length: int) -> Column:
    """The order value at which `length` complete consecutive rows first all hold the flag; null if never."""
    w = history(entity, order).rowsBetween(0, length - 1)
    begins = (F.sum(flag.cast("int")).over(w) == length) & (F.count(F.lit(1)).over(w) == length)
    return F.when(begins, F.col(order))


#: Added before rounding, so that decimal ties (means of a few two-digit values) are not decided by the last bit.
NUDGE = 3e-8


def rounded(df, digits: int = 6):
    """Doubles of a result rounded for comparison."""
    return df.select(*[F.round(F.col(c) + NUDGE, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
