"""Array and table forms of the loops against numpy, and the operators over trees of tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axolin import sources, types
from axolin.operators import direct, fourier, product
from axolin.plans import blocks, multigrid, precondition, solvers, spectral
from axolin.types import Mat, Vec


def system(spark, px=7, py=6):
    cells = spark.range(px * py).select(F.col("id").alias("i"), (1.0 + F.col("id") * 7 % 5).alias("v"))
    a = sources.diffusion_2d(cells, px, py)
    dense = sources.to_numpy(a)
    x = np.arange(a.n) % 7 + 1.0
    return a, dense, x, sources.vector_from(spark, dense @ x)


def test_diffusion(spark):
    a, dense, *_ = system(spark)
    assert np.allclose(dense, dense.T) and (np.linalg.eigvalsh(dense) > 0).all()
    c = 1.0 + np.arange(42) * 7 % 5
    assert np.isclose(dense[8, 9], -2 * c[8] * c[9] / (c[8] + c[9])) and dense[8, 10] == 0
    # an inner cell has no link to the outside, a corner has two
    assert np.isclose(dense[8].sum(), 0) and np.isclose(dense[0].sum(), 2 * c[0])


def test_packed_products(spark, monkeypatch):
    rng = np.random.default_rng(0)
    d = rng.normal(size=(50, 30)) * (rng.random((50, 30)) < 0.2)
    d[7] = 0
    a = sources.matrix_from(spark, d)
    x, y = rng.normal(size=30), rng.normal(size=(50, 3))
    monkeypatch.setattr(blocks, "CHUNK", 37)
    for make in (blocks.Chunks, blocks.Few):
        p = make(a)
        assert np.allclose(p.times(x), d @ x) and np.allclose(p.times_t(y), d.T @ y) and np.allclose(p.times_t(y[:, 0]), d.T @ y[:, 0])
        single = p.times(x.astype(np.float32))
        assert single.dtype == np.float32 and np.allclose(single, d @ x, atol=1e-4)
        z = np.arange(30) % 7
        assert p.most(z).tolist() == [max(z[r != 0], default=-1) for r in d]
        p.release()


METHODS = {
    "cg": (solvers.cg, None), "bicgstab": (solvers.bicgstab, None), "gmres": (lambda *a, **k: solvers.gmres(*a, krylov=8, **k), None), "mixed": (solvers.cg_mixed, None),
    "jacobi": (solvers.cg, precondition.jacobi), "ilut": (solvers.bicgstab, lambda a: precondition.incomplete(a, "ilut", 2)), "ichol0": (solvers.cg, lambda a: precondition.incomplete(a, "ichol0")),
    "chow_patel": (solvers.bicgstab, precondition.chow_patel), "spai": (solvers.bicgstab, lambda a: precondition.inverse_of(precondition.spai(a, 1))),
    "fspai": (solvers.cg, lambda a: precondition.factored_inverse_of(precondition.fspai(a))), "amg": (solvers.cg, lambda a: multigrid.multigrid(a, cutoff=8)),
}


@pytest.mark.parametrize("name", METHODS)
def test_solvers_on_arrays(spark, name):
    method, make = METHODS[name]
    a, _, x, b = system(spark)
    pre = make(a) if make else None
    got = method(a, b, **({"preconditioner": pre} if pre else {}))
    assert np.allclose(blocks.to_array(got.x.df, a.n), x, atol=1e-5) and 0 < got.iterations < 120


@pytest.mark.parametrize("name", ["cg", "bicgstab", "gmres", "jacobi", "ilut"])
def test_solvers_on_tables_agree(spark, monkeypatch, name):
    """With vectors too long for the driver the same methods run on tables."""
    method, make = METHODS[name]
    a, _, x, b = system(spark, 4, 3)
    on_arrays = method(a, b, **({"preconditioner": make(a)} if make else {}))
    monkeypatch.setattr(types, "DRIVER_ROWS", 0)
    got = method(a, b, **({"preconditioner": make(a)} if make else {}))
    assert np.allclose(sources.to_numpy(got.x), x, atol=1e-5) and abs(got.iterations - on_arrays.iterations) <= 2


def test_preconditioners_are_the_same_map_in_both_forms(spark):
    a, _, x, b = system(spark, 4, 3)
    for make in (precondition.jacobi, precondition.row_scaling, lambda a: precondition.incomplete(a, "ilu0", 2), precondition.chow_patel, lambda a: precondition.inverse_of(precondition.spai(a, 1)), lambda a: precondition.factored_inverse_of(precondition.fspai(a)), lambda a: multigrid.multigrid(a, cutoff=5)):
        p = make(a)
        assert np.allclose(p.arrays(x), blocks.to_array(p(blocks.to_frame(spark, x)), a.n))


def test_monitor_and_start_on_arrays(spark):
    a, _, x, b = system(spark)
    seen = []
    got = solvers.gmres(a, b, monitor=lambda k, e: seen.append((k, e)) or k == 3)
    assert got.iterations == 3 and [k for k, _ in seen] == [1, 2, 3]
    assert np.allclose(sources.to_numpy(solvers.bicgstab(a, b, x0=sources.vector_from(spark, x + 1)).x), x, atol=1e-5)
    assert solvers.cg(lambda v: product.gemv(a, Vec(v, a.n)).df, b).error < 1e-7


def test_independent_sets_are_the_same_in_both_forms(spark, monkeypatch):
    a, *_ = system(spark)
    want = sorted(map(tuple, multigrid.aggregate_mis2(a).collect()))
    monkeypatch.setattr(types, "DRIVER_ROWS", 0)
    assert sorted(map(tuple, multigrid.aggregate_mis2(a).collect())) == want and len({r for _, r in want}) > 2


def test_spectra_in_both_forms(spark, monkeypatch):
    a, dense, *_ = system(spark, 5, 4)
    want = np.linalg.eigvalsh(dense)[::-1]
    for limit in (types.DRIVER_ROWS, 0):
        monkeypatch.setattr(types, "DRIVER_ROWS", limit)
        monkeypatch.setattr(spectral, "DRIVER_ROWS", limit)
        values, vectors = spectral.lanczos(a, 2, 20 if limit else 14, vectors=True)
        assert np.allclose(values[0], want[0], atol=1e-2 if not limit else 1e-8)
        if limit:
            v = np.zeros((20, 2))
            for r in vectors.collect():
                v[r.i, r.k] = r.v
            assert np.allclose(dense @ v, v * values, atol=1e-6)
            assert abs(spectral.power_iteration(a, 1e-10)[0] - want[0]) < 1e-3


def test_factorization_of_known_rank(spark):
    rng = np.random.default_rng(3)
    v = rng.random((30, 2)) @ rng.random((2, 20))
    start = lambda m, n, seed: sources.matrix_from(spark, np.random.default_rng(seed).random((m, n)) + 0.1)
    w, h, steps, err = spectral.nmf(sources.matrix_from(spark, v), 2, start(30, 2, 1), start(2, 20, 2), tol=1e-3, every=20)
    got = sources.to_numpy(w) @ sources.to_numpy(h)
    assert err < 5e-3 and np.isclose(np.linalg.norm(got - v) / np.linalg.norm(v), err, atol=1e-6) and steps > 20
    assert np.linalg.norm(v - v.mean()) / np.linalg.norm(v) > 0.2


def test_small_singular_values_keep_their_digits(spark):
    rng = np.random.default_rng(4)
    u, _ = np.linalg.qr(rng.normal(size=(60, 4)))
    v, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    s = np.array([1.0, 1e-3, 1e-6, 1e-10])
    a = u * s @ v.T
    left, got, right = spectral.svd(sources.matrix_from(spark, a))
    assert np.allclose(got, s, rtol=1e-4, atol=0) and left.n == 4
    assert np.allclose(sources.to_numpy(left) * got @ right.T, a, atol=1e-12)
    flat = spectral.svd(sources.matrix_from(spark, np.outer(np.arange(1.0, 9), [1.0, 2, 3])))
    assert flat[0].n == 1


def test_qr_keeps_its_first_level_in_all_tasks(spark):
    """More partitions than one merge takes, some of them empty."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(90, 3))
    cells = sources.matrix_from(spark, a)
    spread = Mat(cells.df.repartition(20, "i"), 90, 3)
    r = direct.qr_r(spread, fan=2)
    assert np.allclose(r.T @ r, a.T @ a) and (np.diag(r) >= 0).all() and np.allclose(np.tril(r, -1), 0)
    q, _ = direct.qr(spread)
    assert np.allclose(sources.to_numpy(q) @ r, a)


@pytest.mark.parametrize("kind", ["lower", "upper"])
def test_triangles_by_halves(spark, kind):
    rng = np.random.default_rng(6)
    t = (np.tril if kind == "lower" else np.triu)(rng.random((21, 21))) + 3 * np.eye(21)
    x = rng.random((21, 3))
    for transposed, flip in ((False, False), (True, True)):
        b = (t.T if transposed else t) @ x
        got = direct.trsm(sources.matrix_from(spark, t), sources.matrix_from(spark, b.T if flip else b), kind, transposed=transposed, block=4, transposed_b=flip)
        assert np.allclose(sources.to_numpy(got), x)
    with pytest.raises(ZeroDivisionError):
        direct.trsv(sources.matrix_from(spark, t - np.diag(np.diag(t))), sources.zero_vector(spark, 21), kind)


@pytest.mark.parametrize("n", [1, 60, 64, 53])
def test_long_transform(spark, monkeypatch, n):
    rng = np.random.default_rng(n)
    z = rng.normal(size=n) + 1j * rng.normal(size=n)
    d = spark.createDataFrame([(k, float(c.real), float(c.imag)) for k, c in enumerate(z)], "k long, re double, im double")
    monkeypatch.setattr(fourier, "TASK_CELLS", 16)

    def back(d):
        out = np.zeros(n, complex)
        for r in d.collect():
            out[r.k] = r.re + 1j * r.im
        return out

    assert np.allclose(back(fourier.long_fft(d, n)), np.fft.fft(z)) and np.allclose(back(fourier.long_fft(d, n, True)), np.fft.ifft(z))
    if n == 53:
        assert np.allclose(back(fourier.long_chirp(d, n)), np.fft.fft(z))


def test_structured_products(spark):
    rng = np.random.default_rng(8)
    n = 37
    e, c, x = rng.normal(size=2 * n - 1), rng.normal(size=n), rng.normal(size=n)
    i, j = np.indices((n, n))
    v = lambda y: sources.vector_from(spark, y)
    assert np.allclose(sources.to_numpy(product.toeplitz(v(e), v(x))), e[n - 1 + i - j] @ x)
    assert np.allclose(sources.to_numpy(product.hankel(v(e), v(x))), e[i + j] @ x)
    assert np.allclose(sources.to_numpy(product.circulant(v(c), v(x))), c[(i - j) % n] @ x)
    points = rng.uniform(-1, 1, 9)
    assert np.allclose(sources.to_numpy(product.vandermonde(v(points), v(x))), np.vander(points, n, increasing=True) @ x)
    sparse = Vec(v(x).df.where("i % 3 = 0"), n)
    assert np.allclose(sources.to_numpy(product.vandermonde(v(points), sparse)), np.vander(points, n, increasing=True) @ np.where(np.arange(n) % 3 == 0, x, 0))


def test_vandermonde_of_many_coefficients(spark, monkeypatch):
    monkeypatch.setattr(product, "COEFFICIENTS", 4)
    x, points = np.arange(11.0), np.array([0.5, -0.3, 0.0])
    got = product.vandermonde(sources.vector_from(spark, points), sources.vector_from(spark, x))
    assert np.allclose(sources.to_numpy(got), np.vander(points, 11, increasing=True) @ x)


def test_error_functions(spark):
    import math

    from axolin.functions import erf, erfc

    xs = [-30.0, -6.0, -2.0, -0.3, 0.0, 0.1, 1.9, 2.0, 2.1, 3.0, 5.0, 9.0, 40.0]
    for r in spark.createDataFrame([(x,) for x in xs], "v double").select("v", erf(F.col("v")).alias("a"), erfc(F.col("v")).alias("b")).collect():
        assert math.isclose(r.a, math.erf(r.v), rel_tol=1e-12, abs_tol=1e-15) and math.isclose(r.b, math.erfc(r.v), rel_tol=1e-11, abs_tol=1e-300)
