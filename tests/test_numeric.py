"""Sequential kernels against numpy, without Spark."""

import numpy as np
import pytest

from axolin.operators.fourier import _chirp
from axolin.plans import precondition, spectral


def laplace(n):
    return np.diag(np.full(n, 4.0)) + np.diag(np.full(n - 1, -1.0), 1) + np.diag(np.full(n - 1, -1.0), -1)


def rows(a):
    return [{j: float(v) for j, v in enumerate(r) if v} for r in a]


def product(factors, n):
    lo, up = np.eye(n), np.zeros((n, n))
    for i, r in enumerate(factors):
        for j, v in r.items():
            (lo if j < i else up)[i, j] = v
    return lo @ up


@pytest.mark.parametrize("kind", ["ilu0", "ilut", "ichol0"])
def test_incomplete_factors_are_exact_without_fill(kind):
    a = laplace(9)
    f = precondition.FACTORS[kind](rows(a))
    assert np.allclose(product(f, 9), a)
    assert np.allclose(precondition.solve_lu(f, a @ np.arange(9.0)), np.arange(9.0))


def test_ilut_keeps_large_entries_only():
    a = laplace(12) + 1e-7
    assert all(sum(c != i for c in r) <= 2 for i, r in enumerate(precondition.factor_ilut(rows(a), 1)))


def test_zero_pivot_raises():
    with pytest.raises(ZeroDivisionError):
        precondition.factor_ilut(rows(np.array([[0.0, 1.0], [1.0, 1.0]])))


@pytest.mark.parametrize("n", [1, 2, 7, 16, 45])
def test_chirp_transform(n):
    z = np.random.default_rng(n).normal(size=n) + 1j
    got = _chirp(z)
    assert np.isfinite(got).all() and np.allclose(got, np.fft.fft(z))


def test_tridiagonal_eigenvalues():
    rng = np.random.default_rng(5)
    d, e = rng.normal(size=40), np.append(0, rng.normal(size=39))
    want = np.linalg.eigvalsh(np.diag(d) + np.diag(e[1:], 1) + np.diag(e[1:], -1))
    assert np.allclose(spectral.bisect(d, e, 1e-10), want, atol=1e-8)
    assert np.allclose(spectral.tridiagonal_eigen(d, e)[0], want)
    v = spectral.inverse_iteration(d, e, want[3])
    t = np.diag(d) + np.diag(e[1:], 1) + np.diag(e[1:], -1)
    assert np.linalg.norm(t @ v - want[3] * v) < 1e-6


def test_tridiagonal_form():
    a = np.random.default_rng(1).normal(size=(8, 8))
    a = a + a.T
    d, e, q = spectral.tridiagonalize(a)
    t = np.diag(d) + np.diag(e[1:], 1) + np.diag(e[1:], -1)
    assert np.allclose(q @ t @ q.T, a) and np.allclose(q @ q.T, np.eye(8))
