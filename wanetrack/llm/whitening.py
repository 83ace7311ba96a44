"""Whitening of embeddings by an incremental eigendecomposition.

Every task keeps the spectrum of the vectors it has seen and adds each further one as a
centred rank-one update; spectra are combined by the same updates; a distributed
Rayleigh-Ritz step over all vectors then brings the components to double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wanetrack.llm.scratch import Scratch

SCALE = 256
COMPONENTS = 4
#: Vectors a task updates its spectrum with; spectra that one task combines.
PER_TASK, FAN_IN = 4096, 16
#: Entries from here on are no exact integers as doubles; vectors that hold one are dropped.
LARGEST = float(1 << 53)
_EPS = np.finfo(float).eps


def secular_roots(poles: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(poles) + rho z z', rho > 0, and the table of poles[j] - root[i].

    Poles ascend strictly and no z is 0, so the roots interlace: root i lies between pole
    i and the next. All roots are sought at once, each as a distance from its nearer pole,
    by interpolating the sums over the poles on its left and right as simple fractions;
    a step that leaves the bracket is replaced by bisection.
    """
    n = len(poles)
    w = rho * z * z
    ends = np.append(poles[1:], poles[-1] + w.sum())
    gap = ends - poles
    mid = 1 + (w / (poles[None, :] - (poles + gap / 2)[:, None])).sum(axis=1)
    near_left = mid >= 0
    near_left[-1] = True
    origin = np.where(near_left, poles, ends)
    delta = poles[None, :] - origin[:, None]
    # the pole on the right of the last root has no weight
    right = np.append(delta[np.arange(n - 1), np.arange(1, n)], gap[-1])
    left = delta[np.arange(n), np.arange(n)]
    lo, hi = np.where(near_left, 0.0, -gap / 2), np.where(near_left, gap / 2, 0.0)
    hi[-1] = gap[-1]
    tau = (lo + hi) / 2
    low = np.tri(n)
    todo = np.ones(n, bool)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for _ in range(100):
            inv = 1 / (delta - tau[:, None])
            part = inv * low
            under, over = part @ w, (inv - part) @ w
            f = 1 + under + over
            todo &= ~(np.abs(f) <= 4 * _EPS * (1 + over - under)) & (hi - lo > 2 * _EPS * np.maximum(np.abs(lo), np.abs(hi)))
            if not todo.any():
                break
            psi = (part * part) @ w
            phi = (inv * inv) @ w - psi
            hi, lo = np.where(f > 0, tau, hi), np.where(f > 0, lo, tau)
            a, b = left - tau, right - tau
            c = f - a * psi - b * phi
            p, q = (a + b) * f - a * b * (psi + phi), a * b * f
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
            step = tau + np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            inside = np.isfinite(step) & (step > lo) & (step < hi)
            tau = np.where(todo, np.where(inside, step, (lo + hi) / 2), tau)
    return origin + tau, delta - tau[:, None]


def rank_one(values: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of diag(values) + rho z z', rho > 0.

    Deflation first: a component that z does not touch keeps its pair; of two poles that
    are equal a rotation frees one. The weights are then computed anew from the roots, for
    which the vectors are orthogonal to working precision.
    """
    n = len(values)
    order = np.argsort(values, kind="stable")
    poles, z = values[order], z[order]
    basis = np.eye(n)[:, order]
    tol = 8 * _EPS * max(np.abs(poles).max(), rho * float(z @ z))
    live = np.flatnonzero(rho * np.abs(z) * np.linalg.norm(z) > tol)
    if len(live) and (np.diff(poles[live]) <= tol).any():
        kept = [live[0]]
        for j in live[1:]:
            i = kept[-1]
            if poles[j] - poles[i] <= tol:
                r = np.hypot(z[i], z[j])
                c, s = z[j] / r, z[i] / r
                basis[:, [i, j]] = basis[:, [i, j]] @ np.array([[c, s], [-s, c]])
                z[i], z[j] = 0.0, r
                kept[-1] = j
            else:
                kept.append(j)
        live = np.array(kept)
    if not len(live):
        return poles, basis
    roots, diff = secular_roots(poles[live], z[live], rho)
    m = len(live)
    if m > 1:
        i, j = np.arange(m - 1)[:, None], np.arange(m)[None, :]
        other = poles[live][i + (i >= j)] - poles[live][None, :]
        weight = np.abs(np.prod(-diff[:-1] / other, axis=0) * diff[-1]) / rho
    else:
        weight = np.abs(diff[0]) / rho
    vec = (np.sqrt(weight) * np.sign(z[live]))[:, None] / diff.T
    vec /= np.linalg.norm(vec, axis=0)
    out_values = poles.copy()
    out_values[live] = roots
    basis[:, live] = basis[:, live] @ vec
    return out_values, basis


@dataclass
class Spectrum:
    """Count, exact sums, and the eigenpairs of the scatter of integer vectors seen so far."""

    dim: int
    n: int = 0
    sums: np.ndarray = field(default=None)
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default=None)

    def __post_init__(self):
        self.sums = np.zeros(self.dim, object) if self.sums is None else self.sums
        self.vectors = np.zeros((self.dim, 0)) if self.vectors is None else self.vectors

    def _grow(self, u: np.ndarray, rho: float) -> None:
        """scatter += rho u u'."""
        size = np.linalg.norm(u)
        if size == 0:
            return
        z = self.vectors.T @ u
        if len(self.values) < self.dim:
            rest = u - self.vectors @ z
            again = self.vectors.T @ rest
            rest -= self.vectors @ again
            z += again
            out = np.linalg.norm(rest)
            if out > 64 * _EPS * size:
                self.vectors = np.column_stack([self.vectors, rest / out])
                self.values, z = np.append(self.values, 0.0), np.append(z, out)
        self.values, turn = rank_one(self.values, z, rho)
        self.vectors = self.vectors @ turn

    def add(self, x: np.ndarray) -> None:
        if self.n:
            self._grow(x - self.sums.astype(float) / self.n, self.n / (self.n + 1))
        self.n += 1
        self.sums = self.sums + x.astype(object)

    def combine(self, other: Spectrum) -> None:
        """Adds the vectors that other has seen: its eigenpairs one by one, and the distance of the two means."""
        if not other.n:
            return
        if self.n:
            self._grow(other.sums.astype(float) / other.n - self.sums.astype(float) / self.n, self.n * other.n / (self.n + other.n))
        for e, v in zip(other.values, other.vectors.T, strict=True):
            if e > 0:
                self._grow(v, e)
        self.n += other.n
        self.sums = self.sums + other.sums

    SCHEMA = "slot int, n long, sums array<decimal(38,0)>, spectrum array<double>, vectors array<double>"

    def row(self, slot: int) -> pa.Table:
        listed = lambda v, kind: pa.array([v], pa.list_(kind))
        return pa.table({
            "slot": pa.array([slot], pa.int32()), "n": pa.array([self.n], pa.int64()),
            "sums": pa.array([[_decimal(v) for v in self.sums]], pa.list_(pa.decimal128(38, 0))),
            "spectrum": listed(self.values, pa.float64()), "vectors": listed(self.vectors.T.ravel(), pa.float64()),
        })

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        d = len(row["sums"])
        sums = np.array([int(v) for v in row["sums"]], object)
        return cls(d, row["n"], sums, np.array(row["spectrum"], float), np.array(row["vectors"], float).reshape(-1, d).T)


def _decimal(v: int):
    import decimal

    return decimal.Decimal(int(v))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The int64 vectors of a batch's first column, one a row."""
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _tree(df: DataFrame, merge: Callable[[list[dict]], pa.Table], scratch: Scratch) -> dict:
    """Folds rows with a `slot` (one a task, numbered) into one, FAN_IN at a time and task."""
    while True:
        df = scratch.table(df, "folded")
        if df.count() <= 1:
            return df.first().asDict()
        by = F.floor(F.col("slot") / FAN_IN).cast("int")
        df = df.groupBy(by.alias("_s")).applyInArrow(lambda t: merge(t.sort_by("slot").to_pylist()), df.schema)


def _merge_spectra(rows: list[dict]) -> pa.Table:
    total = Spectrum.of(rows[0])
    for r in rows[1:]:
        total.combine(Spectrum.of(r))
    return total.row(rows[0]["slot"] // FAN_IN)


def _merge_sums(rows: list[dict]) -> pa.Table:
    total = np.sum([r["total"] for r in rows], axis=0)
    return pa.table({"slot": pa.array([rows[0]["slot"] // FAN_IN], pa.int32()), "total": pa.array([total], pa.list_(pa.float64()))})


def _per_partition(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch], int], pa.Table | None], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = task(batches, TaskContext.get().partitionId())
        if out is not None:
            yield from out.to_batches()

    return df.mapInArrow(run, schema)


def _summed(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], dim: int, shape: tuple[int, int], scratch: Scratch) -> np.ndarray:
    """The sum over all vectors' tasks of part(rows), a small matrix."""

    def task(batches: Iterator[pa.RecordBatch], slot: int) -> pa.Table | None:
        total = None
        for b in batches:
            if b.num_rows:
                now = part(_matrix(b, dim))
                total = now if total is None else total + now
        if total is None:
            return None
        return pa.table({"slot": pa.array([slot], pa.int32()), "total": pa.array([total.ravel()], pa.list_(pa.float64()))})

    done = _tree(_per_partition(fit, task, "slot int, total array<double>"), _merge_sums, scratch)
    return np.array(done["total"]).reshape(shape)


@dataclass
class Whitening:
    """What a fit hands on; its size depends on the dimension alone."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n. Whole parts are taken off as integers, so only the fraction is rounded."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n for s in self.sums], float) / self.n
        return (x - whole).astype(float) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of x on the components; null components (no variance) give NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (self.centred(x) @ self.vectors) / np.where(self.values > 0, np.sqrt(np.maximum(self.values, 0)), np.nan)


def integer_vectors(vector: Column) -> Column:
    """floor(256 c) of each entry as long; null where the vector is null, empty, or holds a null, non-finite or too large entry."""
    v = vector.cast("array<double>")
    sound = F.forall(v, lambda c: F.coalesce(F.abs(c * SCALE) < LARGEST, F.lit(False)))
    return F.when((F.size(v) > 0) & sound, F.transform(v, lambda c: F.floor(c * SCALE).cast("long")))


def fit_whitening(vectors: DataFrame, scratch: Scratch, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of distinct integer vectors x of one length; None without rows.

    Each task adds its vectors to a spectrum of its own; rows of one spectrum a task are
    combined FAN_IN at a time. The last pass over all vectors sums the projections' cross
    products on the whole basis found so far, whose small eigenproblem gives the
    components to double precision however the earlier updates rounded. A further pass
    measures the whitened covariance.
    """
    fit = scratch.table(vectors.distinct(), "distinct")
    n = fit.count()
    if not n:
        return None
    dim = len(fit.first()["x"])
    tasks = -(-n // PER_TASK)
    fit = scratch.table(fit.repartition(tasks, F.xxhash64("x")), "fit")

    def track(batches: Iterator[pa.RecordBatch], slot: int) -> pa.Table | None:
        own = Spectrum(dim)
        for b in batches:
            for x in _matrix(b, dim):
                own.add(x)
        return own.row(slot) if own.n else None

    found = Spectrum.of(_tree(_per_partition(fit, track, Spectrum.SCHEMA), _merge_spectra, scratch))
    assert found.n == n
    # the spectrum's own basis, made orthonormal and completed: directions without variance stay in reach
    basis = np.linalg.qr(np.column_stack([found.vectors[:, ::-1], np.eye(dim)]))[0][:, :dim]
    w = Whitening(n, [int(s) for s in found.sums], np.zeros(0), basis, 0.0, 0.0)

    def cross(x: np.ndarray) -> np.ndarray:
        y = w.centred(x) @ basis
        return y.T @ y

    small = _summed(fit, cross, dim, (dim, dim), scratch) / n
    ritz, turn = np.linalg.eigh((small + small.T) / 2)
    keep = np.arange(dim)[::-1][: min(components, dim)]
    trace = float(ritz.sum())
    values = ritz[keep]
    w.trace, w.values = trace, np.where(values > 16 * dim * _EPS * max(trace, 0.0), values, 0.0)
    w.vectors = basis @ turn[:, keep]
    k = len(keep)

    def white(x: np.ndarray) -> np.ndarray:
        y = np.nan_to_num(w.whitened(x))
        return np.vstack([y.T @ y, y.sum(axis=0)])

    total = _summed(fit, white, dim, (k + 1, k), scratch) / n
    cov = total[:k] - np.outer(total[k], total[k])
    on = w.values > 0
    w.identity_error = float(np.abs(cov - np.eye(k))[np.ix_(on, on)].max(initial=0.0))
    return w


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the dimensions of (n x - S)^2, exact; an error where it passes 63 bits."""
    bound = np.abs(x).max(initial=0) * float(n) + max(map(abs, sums))
    if bound * bound * len(sums) < 2.0**62:
        d = x * np.int64(n) - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = x.astype(object) * n - np.array(sums, object)
    return [int(v) for v in (d * d).sum(axis=1)]


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """rows: vec_id, vector. Each row on the leading components of all rows' distinct vectors, one row a component.

    Entries become floor(256 c). Dropped: null and empty vectors, those with a null,
    infinite or NaN entry or one of 2^45 or more (256 times which is no exact integer as a double), and those whose length is not the most
    frequent one (of equally frequent lengths the largest counts). Rows repeat as often
    as they occur and equal vectors count once in the fit; a null vec_id stays null. A
    component without variance (fewer distinct vectors than dimensions, or one vector) has
    a null `whitened` and is left out of identity_error; `explained` is null if no
    dimension varies. With fewer dimensions than `components` there are as many rows as
    dimensions; without sound vectors, none. Eigenvectors of equal eigenvalues are any
    orthonormal choice, the same for all rows. A deviation beyond 63 bits is an error.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "whiten")
    sound = rows.select(F.col("vec_id").cast("long").alias("vec_id"), integer_vectors(F.col("vector")).alias("x")).filter("x IS NOT NULL")
    sizes = sound.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], WHITENED)
    held = sound.filter(F.size("x") == sizes["d"])
    w, dim = fit_whitening(held.select("x"), scratch, components), sizes["d"]
    names = [f.split()[0] for f in WHITENED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        explained = pa.array(np.where(w.trace > 0, w.values / (w.trace or 1), np.nan), from_pandas=True)
        for b in batches:
            m = b.num_rows
            x = _matrix(b, dim)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(1).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)),
                    pa.array(_deviation(x, w.n, w.sums), pa.int64()).take(pa.array(each)), pa.array(w.whitened(x).ravel(), from_pandas=True),
                    explained.take(pa.array(np.tile(np.arange(k), m))), pa.array(np.full(m * k, w.identity_error)),
                ],
                names=names,
            )

    return held.select("x", "vec_id").mapInArrow(run, WHITENED)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(rows.select("vec_id", F.col("embedding").alias("vector")))
