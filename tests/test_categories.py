"""Drift of categorical features, feature by feature against plain counts."""

import math
from collections import Counter

import numpy as np
import pytest

from wanetrack.operators import drift

NAMES = ["many", "two", "one", "gone", "rare", "void", "unseen"]


def columns(rng, n, p):
    return {
        "many": rng.choice(list("abcdefg"), n, p=p), "two": rng.choice(["x", "y"], n, p=[0.4, 0.6]), "one": ["k"] * n, "gone": rng.choice(["p", "q"], n),
        "rare": [("r" if rng.random() < 0.5 else "s") if i < 10 else None for i in range(n)], "void": [None] * n, "unseen": rng.choice(["u", "v"], n),
    }


def plain(a, b):
    """chi2 and the rate of unseen categories of two lists."""
    x, y = Counter(v for v in a if v is not None), Counter(v for v in b if v is not None)
    n, m, keys = sum(x.values()), sum(y.values()), sorted({*x, *y})
    total = 0.0
    for k in keys:
        for seen, size in ((x[k], n), (y[k], m)):
            e = size * (x[k] + y[k]) / (n + m)
            off = abs(seen - e) - (0.5 if len(keys) == 2 else 0.0)
            total += max(off, 0.0) ** 2 / e
    return total, len(keys) - 1, sum(y[k] for k in keys if k not in x) / m


@pytest.fixture(scope="module")
def batches(spark):
    rng = np.random.default_rng(11)
    p = np.array([4, 3, 3, 2, 2, 1, 1]) / 16
    a, b = columns(rng, 400, p), columns(rng, 300, p[::-1])
    a["void"] = ["w", "z"] * 200
    b["unseen"] = [v if i % 10 else "new" for i, v in enumerate(b["unseen"])]
    del b["gone"]
    frame = lambda c: spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in zip(*c.values(), strict=True)], ", ".join(f"{k} string" for k in c))
    return a, b, frame(a), frame(b)


def test_every_feature_at_once(batches):
    a, b, ref, now = batches
    known = drift.categorical_references(ref, NAMES)
    got = {(r.feature, r.metric): r for r in drift.categorical_drift(known, now, [c for c in NAMES if c != "gone"]).collect()}
    assert {k for k in got if k[1] not in ("chi2", "unseen_rate")} == {("one", "small_sample"), ("gone", "missing"), ("rare", "small_sample"), ("void", "constant")}
    for c in ("many", "two", "unseen"):
        chi2, dof, rate = plain(a[c], b[c])
        assert got[c, "chi2"].value == pytest.approx(chi2) and got[c, "unseen_rate"].value == pytest.approx(rate)
        h = chi2 / 2
        want = math.erfc(math.sqrt(h)) if dof == 1 else sum(math.exp(-h + i * math.log(h) - math.lgamma(i + 1)) for i in range(dof // 2))
        assert dof in (1, 2, 6) and got[c, "chi2"].p_value == pytest.approx(want, rel=1e-8)


def test_severity_needs_significance(batches):
    _, _, ref, now = batches
    labels = [c for c in NAMES if c != "gone"]
    tests = drift.categorical_drift(drift.categorical_references(ref, NAMES), now, labels)
    for how in ("bh", "bonferroni", "none"):
        got = {(r.feature, r.metric): r for r in drift.drift_severity(drift.adjust_p(tests, how)).collect()}
        assert got["many", "chi2"].severity == "warning" and got["many", "chi2"].drifted
        assert got["two", "chi2"].severity == "ok" and got["unseen", "unseen_rate"].severity == "critical"
        assert not got["gone", "missing"].reliable and got["gone", "missing"].severity == "unknown"
        assert (got["two", "chi2"].adjusted is None) == (how == "none")


def test_empty_batch_and_wide_columns(batches, spark):
    _, _, ref, now = batches
    known = drift.categorical_references(ref, ["many", "two"])
    assert {(r.feature, r.metric) for r in drift.categorical_drift(known, now.limit(0), ["many", "two"]).collect()} == {("many", "constant"), ("two", "constant")}
    assert {r.metric for r in drift.categorical_drift(known, now.select("one"), []).collect()} == {"missing"}
    assert drift.categorical_references(ref, ["many"], most=6).count() == 0
    assert drift.prediction_status(drift.prediction_drift(ref.selectExpr("1.0D as v"), ref.limit(3).selectExpr("2.0D as v"), ["v"])).first()[0] == "unknown"
