"""Monotone calibration against pooling in one pass, with ranges of a few blocks."""

import numpy as np
import pytest

from wanetrack.operators import isotonic


def plain(points):
    """(first score, last score, mean) of the blocks of sorted (score, label) pairs."""
    out = []
    for x in sorted({x for x, _ in points}):
        ys = [y for z, y in points if z == x]
        out.append([x, x, sum(ys), len(ys)])
        while len(out) > 1 and out[-2][2] / out[-2][3] >= out[-1][2] / out[-1][3]:
            _, hi, s, n = out.pop()
            out[-1] = [out[-1][0], hi, out[-1][2] + s, out[-1][3] + n]
    return [(a, b, s / n) for a, b, s, n in out]


def value(blocks, x):
    edges = [e for a, b, _ in blocks for e in (a, b)]
    return float(np.interp(x, edges, [v for *_, v in blocks for _ in range(2)]))


def falling(rng, n):
    return [(float(i), float(i < n / 2)) for i in range(n)]


def tied(rng, n):
    return [(float(rng.integers(0, 12)), float(rng.random() < 0.4)) for _ in range(n)]


def noisy(rng, n):
    return [(x, float(rng.random() < x)) for x in rng.random(n).tolist()]


def low_end(rng, n):
    """Each block rises but for the last point, which pulls many ranges down, one after another."""
    return [(float(i), i / n) for i in range(n - 1)] + [(float(n), -n / 3.0)]


@pytest.mark.parametrize("make", [falling, tied, noisy, low_end])
def test_blocks_equal_one_pass(spark, make):
    points = make(np.random.default_rng(5), 90)
    df = spark.createDataFrame(points, "p double, y double")
    got = isotonic.fit_isotonic(df, "p", "y", task_blocks=16)
    want = plain(points)
    rows = [tuple(r) for r in got.orderBy("lo").collect()]
    assert len(rows) == len(want)
    np.testing.assert_allclose(rows, want, atol=1e-12)
    asked = [-1.0, *np.linspace(-0.2, 91.0, 60).tolist(), *[x for x, _ in points]]
    scored = isotonic.apply_isotonic(got, spark.createDataFrame([(x, i) for i, x in enumerate(asked)], "p double, i int"), "p")
    assert scored.columns == ["p", "i", "calibrated"]
    for r in scored.collect():
        assert abs(r.calibrated - min(max(value(want, r.p), 0.0), 1.0)) < 1e-12
    assert scored.count() == len(asked)


def test_rows_left_out_and_one_class(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0.1, 0), (0.1, 1), (0.5, 1), (None, 1), (nan, 0), (inf, 0), (0.7, None)]
    df = spark.createDataFrame(rows, "p double, y int")
    blocks = isotonic.fit_isotonic(df, "p", "y")
    assert [tuple(r) for r in blocks.orderBy("lo").collect()] == [(0.1, 0.1, 0.5), (0.5, 0.5, 1.0)]
    got = isotonic.apply_isotonic(blocks, df, "p").collect()
    assert len(got) == len(rows) and sum(r.calibrated is None for r in got) == 3
    for part in (df.filter("y = 1"), df.limit(0)):
        none = isotonic.fit_isotonic(part, "p", "y")
        assert none.count() == 0
        asked = spark.createDataFrame([(-0.5,), (0.25,), (2.0,), (None,)], "p double")
        assert sorted((r.calibrated for r in isotonic.apply_isotonic(none, asked, "p").collect()), key=str) == [0.0, 0.25, 1.0, None]
    assert isotonic.apply_isotonic(blocks, df.limit(0), "p").count() == 0


def test_ranges_without_blocks(spark):
    """Many ranges, most of them without a block: the nearest ones lie several ranges away, or on one side only."""
    rng = np.random.default_rng(3)
    blocks = [(0.2, 0.21, 0.1), (0.22, 0.22, 0.3), (0.8, 0.8, 0.9)]
    xs = [*rng.random(600).tolist(), *[e for a, b, _ in blocks for e in (a, b)], *[0.5] * 300]
    keys = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        asked = spark.createDataFrame(list(enumerate(xs)), "i int, p double")
        got = {r.i: r.calibrated for r in isotonic.apply_isotonic(spark.createDataFrame(blocks, "lo double, hi double, calibrated double"), asked, "p").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    np.testing.assert_allclose([got[i] for i in range(len(xs))], [value(blocks, x) for x in xs], atol=1e-12)


@pytest.mark.parametrize("make", [falling, tied, noisy, low_end])
def test_more_ranges_than_asked_for(spark, monkeypatch, make):
    """Blocks of ranges that are no neighbours were pooled, round after round without an end."""
    rounds, frame = [], type(spark.range(0))
    deal, write = frame.repartitionByRange, isotonic.written

    def counted(df, label):
        rounds.append(label)
        assert len(rounds) < 12
        return write(df, label)

    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *cols: deal(self, max(n, 7), *cols))
    monkeypatch.setattr(isotonic, "written", counted)
    points = make(np.random.default_rng(5), 90)
    df = spark.createDataFrame(points, "p double, y double")
    for task_blocks in (1 << 20, 40):
        rounds.clear()
        rows = [tuple(r) for r in isotonic.fit_isotonic(df, "p", "y", task_blocks=task_blocks).orderBy("lo").collect()]
        want = plain(points)
        assert len(rows) == len(want)
        np.testing.assert_allclose(rows, want, atol=1e-12)
