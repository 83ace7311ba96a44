"""CAL6: monotone calibration by pooling adjacent violators in ranges of the scores' order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanetrack.functions.exprs import finite
from wanetrack.functions.ranges import in_ranges
from wanetrack.sources.tables import written

#: Blocks that one task pools, a few numbers each.
TASK_BLOCKS = 1 << 20
_BLOCKS = "lo double, hi double, s double, n double, open boolean, cum_s double, cum_n double, part int, upper boolean"


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks of one range, pooled until their means rise. An open block is one with the next, whatever the means."""
    from pyspark import TaskContext

    lo, hi, s, n, open_ = [], [], [], [], []
    for batch in batches:
        for a, b, t, m, o in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            while s and (open_[-1] or s[-1] * m >= t * n[-1]):  # the mean before is not below this one
                a, t, m = lo.pop(), t + s.pop(), m + n.pop()
                hi.pop(), open_.pop()
            for x, v in zip((lo, hi, s, n, open_), (a, b, t, m, o), strict=True):
                x.append(v)
    k = len(lo)
    columns = [pa.array(x, pa.float64()) for x in (lo, hi, s, n)] + [pa.array(open_, pa.bool_())]
    columns += [pa.array(np.cumsum(np.array(x, float))) for x in (s, n)]
    columns += [pa.array(np.full(k, TaskContext.get().partitionId(), np.int32)), pa.array(np.arange(k) >= k // 2)]
    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BLOCKS.split(", ")])


def _lower_hull(x: np.ndarray, y: np.ndarray) -> list[int]:
    keep: list[int] = []
    for i in range(len(x)):
        while len(keep) > 1 and (y[keep[-1]] - y[keep[-2]]) * (x[i] - x[keep[-1]]) >= (y[i] - y[keep[-1]]) * (x[keep[-1]] - x[keep[-2]]):
            keep.pop()
        keep.append(i)
    return keep


def _opened(blocks: DataFrame) -> DataFrame | None:
    """None if the blocks rise over the borders of their ranges too; else blocks, open where the whole shows that they must be pooled on.

    The function's blocks end where the lower hull of the running sums has its corners. A
    line between the sums at two ranges' ends lies on or above that hull, so a block that
    ends above such a line ends at no corner. One row a range is read.
    """
    mean = F.col("s") / F.col("n")
    ends = blocks.groupBy("part").agg(
        F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"), F.max_by("open", "lo").alias("open"), F.sum("s").alias("s"), F.sum("n").alias("n")
    ).orderBy("part").toPandas()  # one row a range
    first, last = ends["first"].to_numpy(), ends["last"].to_numpy()
    if (last[:-1] < first[1:]).all() and not ends["open"].any():
        return None
    x, y = (np.concatenate([[0.0], ends[c].cumsum()]) for c in "ns")
    corners = _lower_hull(x, y)
    hull_x, hull_y = x[corners], y[corners]
    base = dict(zip(ends["part"].tolist(), zip(x[:-1].tolist(), y[:-1].tolist(), strict=True), strict=True))
    slack = 1e-9 * max(float(np.abs(y).max()), 1.0)
    names = [c.split()[0] for c in _BLOCKS.split(", ")]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([base[p] for p in batch.column("part").to_pylist()]).reshape(-1, 2)
            w, s = (batch.column(c).to_numpy() + at[:, i] for i, c in enumerate(("cum_n", "cum_s")))
            now = np.asarray(batch.column("open").to_numpy(zero_copy_only=False), bool) | (s > np.interp(w, hull_x, hull_y) + slack)
            yield pa.RecordBatch.from_arrays([pa.array(now) if c == "open" else batch.column(c) for c in names], names=names)

    return blocks.mapInArrow(mark, _BLOCKS)


def fit_isotonic(df: DataFrame, p: str, y: str, task_blocks: int = TASK_BLOCKS) -> DataFrame:
    """(lo, hi, calibrated): the blocks of the least-squares rising step function of the score, one row a block.

    Equal scores are one point, the mean of their labels. The points are cut into ranges of
    the score's order and each range is pooled by a task of its own; what is pooled there
    stays pooled in the whole. The blocks that are left, few as a rule, are cut anew and
    pooled again until no two neighbours in different ranges violate the order; every
    second round cuts the ranges before at their middles, so each border is inside a
    range soon, and what then fits into one task is pooled by one. The running sums at the
    ranges' ends show far apart blocks that are one, so a low end does not travel from
    range to range.

    Rows without a finite score and label are left out. With no rows, or labels of one
    class alone (all 0 or all 1), there are no blocks.
    """
    points = df.select(finite(p).alias("lo"), finite(y).alias("_y")).filter("lo is not null and _y is not null")
    points = points.select((F.col("lo") + 0.0).alias("lo"), "_y").groupBy("lo").agg(F.sum("_y").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    blocks = written(points.select("lo", F.col("lo").alias("hi"), "s", "n", F.lit(False).alias("open")), "points")
    total = blocks.agg(F.count(F.lit(1)), F.sum("s"), F.sum("n")).first()
    n, parts = total[0], 0
    if n and total[1] in (0, total[2]):
        blocks, n = blocks.limit(0), 0
    halved = True
    while n:
        halved = not halved
        if parts and n <= task_blocks:
            cut = blocks.repartition(1)
        elif halved:
            cut = blocks.repartitionById(parts + 1, F.col("part") + F.col("upper").cast("int"))
        else:
            cut = blocks.repartitionByRange(-(-n // task_blocks), "lo")
        cut = cut.select("lo", "hi", "s", "n", "open").sortWithinPartitions("lo")
        done = written(cut.mapInArrow(_pool, _BLOCKS), "blocks")
        if (blocks := _opened(done)) is None:
            blocks = done
            break
        n, last = done.agg(F.count(F.lit(1)), F.max("part")).first()
        parts = last + 1  # as they were dealt, which may be more than were asked for
    return blocks.select("lo", "hi", (F.col("s") / F.col("n")).alias("calibrated"))


def apply_isotonic(blocks: DataFrame, df: DataFrame, p: str) -> DataFrame:
    """df with `calibrated`: the block's value, between blocks the line from one to the next, beyond the ends the end's value; within 0 and 1.

    Rows and blocks are laid out together in ranges of the score's order, and each range
    takes the nearest block on either side from the ranges around it: no side is broadcast,
    however many blocks there are. Without blocks scores are only clipped; scores that
    are null or not finite get null.
    """
    block = F.struct(*(F.col(c).alias(f"_{c}") for c in ("lo", "hi", "calibrated")))
    rows = df.select(F.struct(*map(_quoted, df.columns)).alias("_row"), finite(_quoted(p)).alias("_x"))
    none = F.lit(None).cast(dict(rows.dtypes)["_row"])
    both = rows.withColumn("_block", F.lit(None).cast("struct<_lo:double,_hi:double,_calibrated:double>")).unionByName(
        blocks.select(none.alias("_row"), F.col("lo").alias("_x"), block.alias("_block"))
    )
    laid = in_ranges(both, F.col("_x"), F.col("_block").isNull())
    per = laid.groupBy("_range").agg(F.max("_block").alias("_top"), F.min("_block").alias("_low"))
    # lead steps on with the row; the first in a frame that reaches to the end is sought anew for each row
    around = per.select(
        F.col("_range").alias("_r"), F.last("_top", True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.expr("lead(_low) ignore nulls over (order by _range)").alias("_after"),
    )  # one row a range
    inside = Window.partitionBy("_range").orderBy("_x", F.col("_block").isNull(), "_tie")
    near = laid.join(F.broadcast(around), F.col("_range") == F.col("_r")).select(
        "_row", "_x", "_block", F.coalesce(F.last("_block", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_before").alias("_b"),
        F.coalesce(F.expr("lead(_block) ignore nulls over (partition by _range order by _x, _block is null, _tie)"), "_after").alias("_a"),
    )
    return near.filter("_block is null").select("_row.*", F.when(F.col("_x").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), _value()))).alias("calibrated"))


def _quoted(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def _value() -> Column:
    x, b, a = F.col("_x"), F.col("_b"), F.col("_a")
    line = b["_calibrated"] + (a["_calibrated"] - b["_calibrated"]) * (x - b["_hi"]) / (a["_lo"] - b["_hi"])
    return F.when(b.isNull() & a.isNull(), x).when(b.isNull(), a["_calibrated"]).when(a.isNull() | (x <= b["_hi"]), b["_calibrated"]).otherwise(line)
