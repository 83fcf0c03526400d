"""Block rotations and bisected intervals against numpy."""

import numpy as np
import pytest

from axolin import sources
from axolin.plans import bidiagonal, jacobi, spectral


@pytest.mark.parametrize("n", [1, 2, 5, 6])
def test_tournament(n):
    rounds = jacobi.tournament(n)
    met = [x for r in rounds for x in r]
    assert sorted(met) == [(p, q) for p in range(n) for q in range(p + 1, n)]
    assert all(len({k for x in r for k in x}) == 2 * len(r) for r in rounds)


@pytest.mark.parametrize("n, size", [(13, 4), (5, 8)])
def test_block_rotations(spark, n, size):
    r = np.random.default_rng(n)
    q, _ = np.linalg.qr(r.normal(size=(n, n)))
    d = np.concatenate([[5.0, 5.0, -3.0, 0.0, 1e-6], r.normal(size=max(0, n - 5))])[:n]
    a = q * d @ q.T
    values, vectors = jacobi.eigen(sources.matrix_from(spark, (a + a.T) / 2), size, vectors=True)
    got = np.array([x.value for x in values.orderBy("k").collect()])
    assert np.allclose(got, np.sort(d)[::-1], atol=1e-12)
    v = np.zeros((n, n))
    for x in vectors.collect():
        v[x.i, x.k] = x.v
    assert np.allclose(v.T @ v, np.eye(n)) and np.allclose(a @ v, v * got, atol=1e-11)


def test_intervals(spark):
    r = np.random.default_rng(3)
    for d, e in ((r.normal(size=40), np.append(0, r.normal(size=39))), (np.full(9, 2.0), np.zeros(9)), (np.array([1.0]), np.array([0.0])), (np.zeros(4), np.zeros(4)), (np.zeros(0), np.zeros(0))):
        t = np.diag(d) + np.diag(e[1:], 1) + np.diag(e[1:], -1)
        table = spectral.bisect_table(spark, d, e, 1e-13)
        rows = sorted((x.k, x.value) for x in table.collect())
        assert [k for k, _ in rows] == list(range(len(d)))
        assert np.allclose([v for _, v in rows], np.linalg.eigvalsh(t) if len(d) else [], atol=1e-10)
        assert not len(d) or table.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("a", [np.zeros((3, 3)), np.eye(4), np.diag([2.0, 2, 0, 0, 2])])
def test_bases_where_nothing_is_left_at_once(a):
    """The fresh direction after the first one is another than that, so that no basis has noise or NaN in it."""
    u, d, e, v = bidiagonal.golub_kahan(lambda x: a @ x, lambda x: a.T @ x, *a.shape)
    s, x, y = bidiagonal.diagonalise(d, e)
    for basis in (u, v):
        assert np.allclose(basis.T @ basis, np.eye(len(a)), atol=1e-12)
    assert np.allclose((u @ x * s) @ (v @ y).T, a)
