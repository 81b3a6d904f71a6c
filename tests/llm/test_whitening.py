"""Whitening against numpy's eigenvectors of the whole matrix."""

import numpy as np
import pytest

from chartlake.llm.whitening import _deviations, polar_factor, spectral_components, whiten

SCHEMA = "vec_id long, embedding array<float>, component int, n long, x string, i int, label int"


def _rows(spark, n=300):
    got = [(r.vec_id, [float(x) for x in r.embedding]) for r in
           spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").limit(n).collect()]
    hot = got[3][1]
    got += [(10_000 + i, hot) for i in range(200)]  # one vector many times
    got += [(20_000, None), (20_001, [None] + hot[1:]), (20_002, [float("nan")] + hot[1:]), (20_003, [float("inf")] + hot[1:]),
            (None, hot), (None, got[5][1]), (7, got[9][1]), (7, got[9][1]), (20_004, hot[:10]), (20_005, []), (20_006, [-0.0] * 64)]
    return [(i, v, 1, 2, "x", 3, 4) for i, v in got]


def _brute(rows, dim, scale=256):
    keep = [(i, v) for i, v, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.zeros((len(keep), dim), np.int64)
    for k, (_, v) in enumerate(keep):
        x[k, :len(v)] = np.floor(scale * np.array(v, np.float32).astype(float)).astype(np.int64)
    return [i for i, _ in keep], x, np.unique(x, axis=0)


@pytest.mark.parametrize("spectrum", [
    lambda r: r.standard_normal(40) ** 2, lambda r: np.repeat([5.0, 2.0, 2.0, 0.0], 6), lambda r: 10.0 ** -np.arange(20),
    lambda r: np.ones(8), lambda r: np.zeros(5), lambda r: np.array([3.0]), lambda r: np.r_[1e6, np.linspace(1, 1 + 1e-9, 9)]])
def test_components_equal_eigenvectors(spectrum):
    rng = np.random.RandomState(1)
    e = spectrum(rng)
    q = np.linalg.qr(rng.standard_normal((len(e), len(e))))[0]
    v = q * e @ q.T
    values, vectors = spectral_components(v)
    assert np.allclose(values, np.sort(e)[::-1], atol=1e-13 * max(1, e.max()) * len(e))
    assert np.abs(vectors.T @ vectors - np.eye(len(e))).max() < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() <= 1e-12 * max(1, e.max())


def test_polar_factor_is_the_sign():
    rng = np.random.RandomState(2)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    e = np.r_[rng.standard_normal(28), 1e-9, -1e-9]
    assert np.abs(polar_factor(q * e @ q.T) - q * np.sign(e) @ q.T).max() < 1e-6


def test_whitened_rows(spark):
    rows = _rows(spark)
    ids, x, fit = _brute(rows, 64)
    n, s = len(fit), fit.sum(0)
    v = np.cov(fit.T.astype(float), bias=True)
    e, c = np.linalg.eigh(v)
    got = whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == 4 * len(ids) and {r.n for r in got} == {n}
    want = {}
    for k in range(4):
        col = c[:, -1 - k] * np.sign(c[np.abs(c[:, -1 - k]).argmax(), -1 - k])
        w = (x - s / n) @ col / np.sqrt(e[-1 - k])
        for i, d, y in zip(ids, ((n * x - s) ** 2).sum(1), w):
            want.setdefault((str(i), k + 1), []).append((int(d), round(float(y), 7)))
    have = {}
    for r in got:
        have.setdefault((str(r.vec_id), r.component), []).append((r.deviation, round(r.whitened, 7)))
        assert abs(r.explained - e[-r.component] / np.trace(v)) < 1e-9 * r.explained and r.identity_error < 1e-9
    for key, rows_of in want.items():
        assert np.allclose(sorted(have[key]), sorted(rows_of), atol=1e-6)


def test_tables_without_components(spark):
    one = spark.createDataFrame([(i, [1.0, 2.0], 1, 2, "x", 3, 4) for i in range(5)], SCHEMA)
    assert whiten(one).collect() == [] and whiten(one.limit(0)).collect() == []
    assert whiten(one.selectExpr("vec_id", "cast(array() as array<float>) as embedding")).collect() == []
    two = spark.createDataFrame([(1, [1.0, 0.0], 1, 2, "x", 3, 4), (2, [0.0, 0.0], 1, 2, "x", 3, 4)], SCHEMA)
    assert sorted((r.component, round(abs(r.whitened), 9)) for r in whiten(two).collect()) == [(1, 1.0), (1, 1.0)]


def test_deviation_is_exact_or_null():
    x = np.array([[3, -1], [10**9, 0], [2 * 10**9, 2 * 10**9]], np.int64)
    want = [sum((5 * int(a) - s) ** 2 for a, s in zip(r, (7, 1))) for r in x]
    assert _deviations(x, 5, [7, 1]) == [w if w < 2**63 else None for w in want] and want[2] >= 2**63
    assert _deviations(np.array([[2**62]]), 4, [2**64]) == [0]
