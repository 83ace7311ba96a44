"""Exact quantiles of many columns at once in bounded memory."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wanetrack.functions.arrays import doubles, matrix

#: Counters that a task holds, and values of one interval that are fetched and sorted instead of counted further.
CELLS, GATHER = 1 << 21, 4096
_TOP = np.uint64(1 << 63)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers that compare alike; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def from_bits(k: np.ndarray) -> np.ndarray:
    return np.where(k & _TOP, k ^ _TOP, ~k).view(np.float64)


@dataclass
class _Target:
    """A wanted rank of a column; `prefix` are its value's leading bits so far, `rank` its place among values with that prefix."""

    column: int
    rank: int
    prefix: int = 0
    value: float | None = None


def _intervals(targets: Sequence[_Target]) -> dict[int, np.ndarray]:
    """By column the distinct prefixes that are still open."""
    held: dict[int, set[int]] = {}
    for t in targets:
        if t.value is None:
            held.setdefault(t.column, set()).add(t.prefix)
    return {c: np.array(sorted(p), np.uint64) for c, p in held.items()}


def _hits(batches: Iterator[pa.RecordBatch], names: Sequence[str], open_: dict[int, np.ndarray], known: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, interval number, bits) of the values that lie in an open interval, column by column and batch by batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        for c, prefixes in open_.items():
            x = matrix(batch, names[c : c + 1])[:, 0]
            k = ordered_bits(x[np.isfinite(x)])
            lead = k >> np.uint64(64 - known) if known else np.zeros(len(k), np.uint64)
            at = np.searchsorted(prefixes, lead)
            ok = (at < len(prefixes)) & (prefixes[np.minimum(at, len(prefixes) - 1)] == lead)
            yield c, at[ok], k[ok]


def exact_quantiles(df: DataFrame, columns: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """(feature, n, quantiles): the count of finite values and, for each level, the value at rank level * (n - 1), interpolated.

    A quantile's value is narrowed down bit by bit: each pass over the rows counts values
    by the next bits within the intervals that the wanted ranks lie in, for all columns
    and levels together. Once an interval holds few values they are fetched; else its bits
    run out. So a task holds CELLS counters whatever the rows, no column is sorted, and
    the driver gets one row a column and level. Two or three passes are usual, and their
    number is bounded by the 64 bits. Jobs run when this is called. A column without
    finite values has n = 0 and null quantiles.
    """
    spark = df.sparkSession
    names = [f"_{i}" for i in range(len(columns))]
    rows = doubles(df, columns)
    targets, counts, known = [_Target(c, -1) for c in range(len(columns))], {}, 0
    while True:
        open_ = _intervals(targets)
        if not open_:
            break
        slots = {c: (i, len(p)) for c, i, p in ((c, sum(len(q) for d, q in open_.items() if d < c), p) for c, p in open_.items())}
        total = sum(len(p) for p in open_.values())
        bits = min(16, 64 - known, max(1, int(math.log2(max(CELLS // total, 2)))))
        found = _counted(rows, names, open_, slots, total, known, bits)
        if not counts:  # the first pass also tells how many values there are
            counts = {r["slot"]: r["n"] for r in found.groupBy("slot").agg(F.sum("n").alias("n")).collect()}  # a row a column
            targets = [_Target(c, r) for c in range(len(columns)) for r in sorted({x for q in levels for x in _ends(q, counts.get(c, 0))})]
        wanted = [(i, slots[t.column][0] + int(np.searchsorted(open_[t.column], np.uint64(t.prefix))), t.rank) for i, t in enumerate(targets) if t.value is None]
        if not wanted:
            break
        upto = F.sum("n").over(Window.partitionBy("slot").orderBy("bin"))
        ask = F.broadcast(spark.createDataFrame(wanted, "target int, slot int, rank long"))  # a row a column and level
        placed = found.withColumn("upto", upto).join(ask, "slot").filter("rank < upto AND rank >= upto - n")
        known += bits
        left = 0
        for r in placed.select("target", "bin", "n", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")).collect():
            t = targets[r["target"]]
            t.prefix, t.rank = t.prefix << bits | r["bin"], r["rank"]
            left = max(left, r["n"])
        if known == 64:
            for t in targets:
                if t.value is None:
                    t.value = float(from_bits(np.array([t.prefix], np.uint64))[0])
        elif left <= GATHER:
            _fetch(rows, names, targets, known)
    by = {(t.column, r): t.value for t, r in zip(targets, _ranks(targets, levels, counts), strict=True)}
    out = []
    for c, name in enumerate(columns):
        n = counts.get(c, 0)
        values = []
        for q in levels:
            if not n:
                values.append(None)
                continue
            x = q * (n - 1)
            lo, hi = by[c, math.floor(x)], by[c, math.ceil(x)]
            values.append(lo + (hi - lo) * (x - math.floor(x)))
        out.append((name, n, values))
    return spark.createDataFrame(out, "feature string, n long, quantiles array<double>")


def _ends(q: float, n: int) -> tuple[int, ...]:
    return (math.floor(q * (n - 1)), math.ceil(q * (n - 1))) if n else ()


def _ranks(targets: Sequence[_Target], levels: Sequence[float], counts: dict[int, int]) -> list[int]:
    """The ranks that the targets were made for, in their order."""
    return [r for c in dict.fromkeys(t.column for t in targets) if counts.get(c) for r in sorted({x for q in levels for x in _ends(q, counts[c])})]


def _counted(rows: DataFrame, names: Sequence[str], open_: dict[int, np.ndarray], slots: dict[int, tuple[int, int]], total: int, known: int, bits: int) -> DataFrame:
    """(slot, bin, n): values by interval and their next bits."""
    shift, mask = np.uint64(64 - known - bits), np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(total << bits, np.int64)
        for c, at, k in _hits(batches, names, open_, known):
            first, n = slots[c]
            cell = (at.astype(np.int64) << bits) + (k >> shift & mask).astype(np.int64)
            held[first << bits : (first + n) << bits] += np.bincount(cell, minlength=n << bits)
        where = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array((where >> bits).astype(np.int32)), pa.array((where & ((1 << bits) - 1)).astype(np.int32)), pa.array(held[where])], names=["slot", "bin", "n"]
        )

    return rows.mapInArrow(run, "slot int, bin int, n long").groupBy("slot", "bin").agg(F.sum("n").alias("n"))


def _fetch(rows: DataFrame, names: Sequence[str], targets: Sequence[_Target], known: int) -> None:
    """Gives each open target its value: the intervals' values, few in each, sorted."""
    open_ = _intervals(targets)
    offset, at = {}, 0
    for c, p in open_.items():
        offset[c], at = at, at + len(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, slot, k in _hits(batches, names, open_, known):
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array((slot + offset[c]).astype(np.int32)), pa.array(from_bits(k))], names=["slot", "value"])

    wanted = [(i, offset[t.column] + int(np.searchsorted(open_[t.column], np.uint64(t.prefix))), t.rank) for i, t in enumerate(targets) if t.value is None]
    ask = F.broadcast(rows.sparkSession.createDataFrame(wanted, "target int, slot int, rank int"))  # a row a column and level
    held = rows.mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sort_array(F.collect_list("value")).alias("values"))  # GATHER at most
    for r in held.join(ask, "slot").select("target", F.col("values")[F.col("rank")].alias("value")).collect():
        targets[r["target"]].value = r["value"]
