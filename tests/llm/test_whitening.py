import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wanetrack.llm import whitening as W


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_secular_roots(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        poles = np.sort(rng.normal(0, 10, n)) + np.arange(n) * rng.choice([1e-6, 1, 100])
        z, rho = rng.normal(0, 1, n) * 10.0 ** rng.integers(-4, 3, n), float(10.0 ** rng.integers(-3, 3))
        roots, diff = W.secular_roots(poles, z, rho)
        want = np.linalg.eigvalsh(np.diag(poles) + rho * np.outer(z, z))
        assert roots == pytest.approx(want, rel=1e-12, abs=1e-12 * np.abs(want).max())
        assert (roots >= poles).all() and (roots[:-1] <= poles[1:]).all()
        assert diff == pytest.approx(poles[None, :] - roots[:, None], abs=1e-11 * np.abs(want).max())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1.0, 1.0, 2.0, 5.0]), min_size=1, max_size=8), st.data())
def test_rank_one_with_equal_poles_and_untouched_components(values, data):
    z = np.array(data.draw(st.lists(st.sampled_from([0.0, 0.0, 1.0, -2.0, 1e-20]), min_size=len(values), max_size=len(values))))
    d = np.array(values)
    e, q = W.rank_one(d, z, 0.5)
    assert q.T @ q == pytest.approx(np.eye(len(d)), abs=1e-13)
    assert (q * e) @ q.T == pytest.approx(np.diag(d) + 0.5 * np.outer(z, z), abs=1e-12)


@pytest.mark.parametrize(("n", "d"), [(1, 3), (5, 8), (300, 6), (200, 32)])
def test_spectra_combine(n, d):
    rng = np.random.default_rng(n)
    x = np.floor(rng.normal(0, 40, (n, d))).astype(np.int64)
    if d == 6:
        x[:, 4] = x[:, 2]
    parts = []
    for rows in np.array_split(x, 4):
        s = W.Spectrum(d)
        for r in rows:
            s.add(r)
        parts.append(W.Spectrum.of(s.row(0).to_pylist()[0]))
    total = parts[0]
    for p in parts[1:]:
        total.combine(p)
    c = x - x.mean(axis=0)
    assert total.n == n and list(total.sums) == x.sum(axis=0).tolist()
    assert (total.vectors * total.values) @ total.vectors.T == pytest.approx(c.T @ c, abs=1e-9 * max(1, np.abs(c.T @ c).max()))


def plain(vectors, k=4):
    x = np.floor(256 * np.asarray(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return x, n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_whitening(spark, monkeypatch):
    """Repeated rows, bad rows, extra columns; several tasks and several combining rounds."""
    monkeypatch.setattr(W, "PER_TASK", 20)
    monkeypatch.setattr(W, "FAN_IN", 3)
    rng = np.random.default_rng(5)
    v = (rng.normal(0, 1, (300, 7)) * np.array([9, 7, 5, 3, 2, 1, 1])).astype(np.float32)
    v[100:200] = v[7]
    good = [(i, [float(a) for a in row], 1, 2) for i, row in enumerate(v)]
    bad = [(900, None), (901, []), (902, [1.0] * 6), (903, [None] + [1.0] * 6), (904, [float("nan")] + [1.0] * 6), (905, [float("inf")] * 7), (906, [1e300] * 7), (907, [3e38] * 7)]
    rows = spark.createDataFrame(good + [(None, good[3][1], 1, 2), good[5]] + [(*b, 1, 2) for b in bad], "vec_id long, vector array<double>, n int, x int").repartition(5)
    got = W.whiten(rows).toPandas()
    x, n, deviation, white, explained = plain(v)
    assert len(got) == 4 * 302 and got.n.eq(n).all() and n == 200
    one = got[got.vec_id.notna()].drop_duplicates(["vec_id", "component"]).sort_values(["vec_id", "component"])
    assert one.vec_id.nunique() == 300 and (got.vec_id == 5).sum() == 8 and got.vec_id.isna().sum() == 4
    mine = one.whitened.to_numpy().reshape(-1, 4)
    assert mine * np.sign((mine * white).sum(axis=0)) == pytest.approx(white, abs=1e-10)
    assert one.deviation.tolist() == np.repeat(deviation, 4).tolist()
    assert one.explained.tolist()[:4] == pytest.approx(explained.tolist(), rel=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-12


@pytest.mark.parametrize(("vectors", "k"), [([[1.0, 2.0]], 2), ([[1.0, 2.0], [1.0, 2.0]], 2), ([[1.0], [2.0]], 1), ([[1.0, 0, 0, 0, 0], [2.0, 0, 0, 0, 0], [5.0, 1, 0, 0, 0]], 4)])
def test_components_without_variance(spark, vectors, k):
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "vec_id long, vector array<double>")
    got = W.whiten(rows).toPandas().sort_values(["vec_id", "component"])
    rank = np.linalg.matrix_rank(np.array(vectors) - np.mean(vectors, axis=0))
    assert len(got) == k * len(vectors)
    assert (got.whitened.notna() == (got.component <= rank)).all()
    assert (got.identity_error < 1e-9).all() and got.explained.isna().all() == (rank == 0)


def test_no_rows(spark):
    assert W.whiten(spark.createDataFrame([], "vec_id long, vector array<float>")).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id long, vector array<float>")).count() == 0


def test_deviation_is_exact_or_an_error():
    x = np.array([[3, -5], [1 << 30, 7]])
    sums = [17, 1 << 31]
    assert W._deviation(x[:1], 5, sums) == [sum((5 * int(a) - s) ** 2 for a, s in zip(x[0], sums, strict=True))]
    big = [1 << 40, 3]
    assert W._deviation(x, 5, big)[0] == sum((5 * int(a) - s) ** 2 for a, s in zip(x[0], big, strict=True)) > 1 << 63


def test_on_the_table(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").to_pandas().sort_values("vec_id")
    _, n, deviation, white, explained = plain(np.stack(t.embedding))
    got = W.op12_whitening(spark, "/root/testdata/sf0.001").toPandas().sort_values(["vec_id", "component"])
    mine = got.whitened.to_numpy().reshape(-1, 4)
    assert mine * np.sign((mine * white).sum(axis=0)) == pytest.approx(white, abs=1e-9)
    assert got.deviation.tolist() == np.repeat(deviation, 4).tolist() and got.n.eq(n).all()
    assert got.explained.tolist()[:4] == pytest.approx(explained.tolist(), rel=1e-10)
