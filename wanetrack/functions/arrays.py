"""Sums of arrays, and cross products of many columns, as partial sums of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of one block of a cross-product matrix; a task holds a few matrices of twice this many columns.
BLOCK = 1024
#: Partial sums of one key that a task of the first round adds up.
FAN_IN = 64


def matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """The columns as doubles, one row a row; nulls are NaN."""
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]) if columns else np.zeros((batch.num_rows, 0))


def doubles(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, then the columns as doubles, named by number so that no name clashes. NaN and infinities stay.

    As texts: building hundreds of column objects costs more than reading their rows.
    """
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    return df.selectExpr(*map(quoted, keys), *[f"cast({quoted(c)} as double) as _{i}" for i, c in enumerate(columns)])


def partials(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df through task, with a column `part` that tells tasks apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        for b in task(batches):
            yield b.append_column("part", pa.array(np.full(b.num_rows, pid, np.int32)))

    return df.mapInArrow(run, f"{schema}, part int")


def added_up(df: DataFrame, key: str, array: str = "sums") -> DataFrame:
    """(key, array): the arrays of a key, all of one length, added element by element.

    Two rounds: a task adds FAN_IN partial sums of a key, then the few totals of that key.
    """
    kind = dict(df.dtypes)[key]

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        rows = t.column(array).combine_chunks()
        total = rows.flatten().to_numpy().reshape(len(rows), -1).sum(axis=0)
        return pa.table({key: t.column(key).slice(0, 1), array: pa.array([total], pa.list_(pa.float64())), "part": t.column("part").slice(0, 1)})

    schema = f"{key} {kind}, {array} array<double>, part int"
    once = df.select(key, array, "part").groupBy(key, F.floor(F.col("part") / FAN_IN)).applyInArrow(add, schema)
    return once.groupBy(key).applyInArrow(add, schema).select(key, array)


def cross_products(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, sa, sb, saa, sbb, sab) of every ordered pair of columns: sums over the rows where both are finite.

    Values are taken less a constant near their column's mean, so that what is derived
    from the sums keeps its digits. Each task multiplies its rows as matrices and hands on
    one row a column; columns are taken in blocks of BLOCK, one pass over the rows for
    each pair of blocks, so a task's memory is bounded whatever the number of columns.
    """
    blocks = [range(i, min(i + BLOCK, len(columns))) for i in range(0, len(columns), BLOCK)]
    shift = column_means(df, columns)
    out = None
    for i, left in enumerate(blocks):
        for right in blocks[i:]:
            part = _cross_block(df, columns, left, right, shift)
            out = part if out is None else out.unionByName(part)
    return out


def column_means(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Each column's mean, 0 where it has no finite value."""
    names = [f"_{i}" for i in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(names)))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, names)
                m = np.isfinite(x)
                total += [m.sum(axis=0), np.where(m, x, 0).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["k", "sums"])

    row = added_up(partials(doubles(df, columns), run, "k int, sums array<double>"), "k").first()  # one row, two numbers a column
    n, s = np.array(row["sums"]).reshape(2, -1) if row else np.zeros((2, len(names)))
    return s / np.maximum(n, 1)


def _cross_block(df: DataFrame, columns: Sequence[str], left: range, right: range, shift: np.ndarray) -> DataFrame:
    same = left == right
    used = list(left) if same else [*left, *right]
    a, b = np.arange(len(left)), np.arange(len(right)) + (0 if same else len(left))
    names = [f"_{i}" for i in range(len(used))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, names) - shift[used]
            m = np.isfinite(x)
            x = np.where(m, x, 0.0)
            whole = m.all()
            u, v = x[:, a], x[:, b]
            if whole:  # no gaps: the masks are all one
                one = np.ones((1, 1))
                now = [len(x) * np.ones((len(a), len(b))), u.sum(axis=0)[:, None] * one, one * v.sum(axis=0), (u * u).sum(axis=0)[:, None] * one, one * (v * v).sum(axis=0), u.T @ v]
                now = [np.broadcast_to(t, (len(a), len(b))) for t in now]
            else:
                mu, mv = m[:, a].astype(float), m[:, b].astype(float)
                now = [mu.T @ mv, u.T @ mv, mu.T @ v, (u * u).T @ mv, mu.T @ (v * v), u.T @ v]
            now = np.stack(now)
            total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(left, np.int32)), pa.array([total[:, k].ravel() for k in range(len(a))], pa.list_(pa.float64()))], names=["a", "sums"]
            )

    width = len(right)
    summed = added_up(partials(doubles(df, [columns[i] for i in used]), run, "a int, sums array<double>"), "a")
    listed = F.lit(list(columns))
    cell = lambda k: F.col("sums")[F.col("j") + k * width]
    rows = summed.select("a", "sums", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j")).filter(F.col("j") + right[0] > F.col("a"))
    return rows.select(
        listed[F.col("a")].alias("a"), listed[F.col("j") + right[0]].alias("b"), cell(0).cast("long").alias("n"),
        *[cell(k).alias(c) for k, c in enumerate(("sa", "sb", "saa", "sbb", "sab"), 1)],
    )
