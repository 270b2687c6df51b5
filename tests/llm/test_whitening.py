import math

import numpy as np
import pytest

from hitmill.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component int"


def check(got, data, wanted=4):
    """Rows against numpy's eigenvectors of the covariance."""
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in data]
    fit = np.array(sorted({tuple(x) for _, x in good}), np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:wanted], axes[:, ::-1][:, :wanted]
    values = values[values > 1e-9 * values[0]]
    assert len(got) == len(good) * len(values)
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
    for c, e in enumerate(values):
        signs = set()
        for i, x in good:
            r = by_id[i, c + 1][0]
            want = (np.array(x) - sums / n) @ axes[:, c] / math.sqrt(e)
            if abs(want) > 0.01:
                signs.add(want * r.whitened > 0)
            assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-7, abs=1e-7)
            assert r.n == n and r.deviation == sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
            assert r.explained == pytest.approx(e / np.trace(centred.T @ centred / n), rel=1e-9)
            assert r.identity_error < 1e-8
        assert len(signs) == 1


@pytest.mark.parametrize("size,count", [(1, 50), (3, 200), (40, 700), (64, 2000)])
def test_equals_numpy(llm, size, count):
    rng = np.random.default_rng(size)
    x = rng.standard_normal((count, size)) * np.linspace(0.2, 0.1, size) @ np.linalg.qr(rng.standard_normal((size, size)))[0]
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(count + i, v) for i, (_, v) in enumerate(data[: count // 3])] + [(0, data[0][1])]
    df = llm.createDataFrame([(i, v, 7) for i, v in data], SCHEMA).repartition(5)
    check(whitening.whiten(df).collect(), data)


def test_odd_rows(llm):
    rng = np.random.default_rng(2)
    data = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 5)))] + [(None, [0.0] * 5), (200, [-0.0] * 5)]
    odd = [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0]), (302, [float("nan")] * 5), (303, [float("-inf")] * 5), (304, []), (305, [1.0] * 4)]
    df = llm.createDataFrame([(i, v, 7) for i, v in data + odd], SCHEMA)
    check(whitening.whiten(df).collect(), data)


def test_no_variance_and_no_rows(llm):
    for data in ([], [(1, None, 0)], [(1, [2.0, 3.0], 0)], [(i, [2.0, 3.0], 0) for i in range(9)]):
        assert whitening.whiten(llm.createDataFrame(data, SCHEMA)).collect() == []
    line = [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(9)]
    check(whitening.whiten(llm.createDataFrame(line, SCHEMA)).collect(), [(i, v) for i, v, _ in line])


def test_huge_entries_stay_exact(llm):
    data = [(0, [1e300, 0.0]), (1, [-1e9, 3e9]), (2, [1e9, 2e9])]
    out = whitening.whiten(llm.createDataFrame([(i, v, 0) for i, v in data], SCHEMA)).collect()
    assert {r.vec_id for r in out} == {0, 1, 2} and all(r.deviation is None for r in out)
    data = [(i, [1e5 + i, -1e5 * i]) for i in range(7)]
    check(whitening.whiten(llm.createDataFrame([(i, v, 0) for i, v in data], SCHEMA)).collect(), data)


def test_close_eigenvalues_are_certified():
    """Residuals of eigenvalues that differ by a thousandth, without Spark's sums."""
    rng = np.random.default_rng(7)
    size = 100
    axes = np.linalg.qr(rng.standard_normal((size, size)))[0]
    values = np.concatenate([[5, 4.001, 4, 3.999], np.linspace(3.9, 0.5, size - 4)])
    matrix = axes * values @ axes.T

    class Known:
        size = 100

        def times(self, q):
            return matrix @ q

    found, vectors = whitening.eigenpairs(Known(), 4)
    assert np.allclose(found, values[:4], rtol=1e-12)
    assert np.allclose(np.abs((vectors * axes[:, :4]).sum(axis=0)), 1, atol=1e-9)
