"""Substitution by levels, kept reflectors, bidiagonal forms and loops of one action against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axolin import sources, types
from axolin.operators import direct, product, reflectors, substitution
from axolin.plans import bidiagonal, solvers, spectral
from axolin.types import Mat, Vec


def sparse_triangle(n=60, share=0.15, seed=0):
    r = np.random.default_rng(seed)
    t = np.tril(r.normal(size=(n, n)) * (r.random((n, n)) < share), -1)
    return t + np.diag(2.0 + r.random(n))


def level_of(t):
    n = len(t)
    out = np.zeros(n, int)
    for i in range(n):
        out[i] = max((out[j] + 1 for j in range(i) if t[i, j]), default=0)
    return out


@pytest.mark.parametrize("limit", [types.DRIVER_ROWS, 0])
def test_levels(spark, monkeypatch, limit):
    n = 20 if limit else 9
    t = sparse_triangle(n)
    monkeypatch.setattr(types, "DRIVER_ROWS", limit)
    got = {r.i: r.level for r in substitution.levels(sources.matrix_from(spark, t)).collect()}
    assert [got[i] for i in range(n)] == level_of(t).tolist()
    got = {r.i: r.level for r in substitution.levels(sources.matrix_from(spark, t.T), "upper").collect()}
    assert [got[i] for i in range(n)] == level_of(t[::-1, ::-1].T)[::-1].tolist()
    assert substitution.levels(sources.zero_matrix(spark, 0, 0)).count() == 0


@pytest.mark.parametrize("few", [0, 7, 10_000])
@pytest.mark.parametrize("kind", ["lower", "upper"])
def test_frontiers_and_blocks_of_a_chain(spark, few, kind):
    t = sparse_triangle() + np.diag(np.full(59, 0.5), -1)
    t = t if kind == "lower" else t[::-1, ::-1].copy()
    x = np.random.default_rng(1).normal(size=(60, 3))
    cells = sources.matrix_from(spark, t).df.where("i != j")
    got, level = substitution.on_arrays(cells, kind == "lower", np.diag(t), t @ x, few)
    assert np.allclose(got, x)
    assert level.tolist() == (level_of(t) if kind == "lower" else level_of(t[::-1, ::-1])[::-1]).tolist()


@pytest.mark.parametrize("limit", [types.DRIVER_ROWS, 0])
def test_substitution_in_both_forms(spark, monkeypatch, limit):
    n = 24 if limit else 9
    t = sparse_triangle(n)
    x = np.random.default_rng(2).normal(size=(n, 2))
    monkeypatch.setattr(types, "DRIVER_ROWS", limit)
    for kind, m in (("lower", t), ("upper", t.T.copy())):
        for transposed in (False, True) if limit else (kind == "upper",):
            b = (m.T if transposed else m) @ x
            got = substitution.substitute(sources.matrix_from(spark, m), sources.matrix_from(spark, b), kind, transposed=transposed)
            assert np.allclose(sources.to_numpy(got), x)
    unit = np.tril(t, -1) + np.eye(n)
    assert np.allclose(sources.to_numpy(substitution.substitute(sources.matrix_from(spark, t), sources.matrix_from(spark, unit @ x), unit=True)), x)
    with pytest.raises(ZeroDivisionError):
        substitution.substitute(sources.matrix_from(spark, np.tril(t, -1)), sources.matrix_from(spark, x))


def test_blocks_side_by_side(spark):
    t = sparse_triangle(30)
    i, j = np.indices(t.shape)
    own = np.where(i // 8 == j // 8, t, 0)
    x = np.arange(30.0)
    got = direct.block_trsv(sources.matrix_from(spark, t), sources.vector_from(spark, own @ x), 4)
    assert np.allclose(sources.to_numpy(got), x)


def test_missing_right_hand_sides_are_zero(spark):
    a = sources.matrix_from(spark, np.tril(np.ones((4, 4))))
    got = direct.trsv(a, Vec(spark.createDataFrame([(2, 3.0)], "i long, v double"), 4))
    assert sources.to_numpy(got).tolist() == [0, 0, 3, -3]


SHAPES = {"tall": (100, 5, 5, 11, 2), "deficient": (90, 6, 3, 8, 3), "one_block": (7, 4, 4, 20, 2), "short_last": (33, 6, 6, 8, 2), "wide": (4, 7, 4, 3, 2), "empty_blocks": (64, 3, 3, 4, 4)}


@pytest.mark.parametrize("name", SHAPES)
def test_reflectors(spark, name):
    m, n, rank, rows, fan = SHAPES[name]
    r = np.random.default_rng(5)
    a = r.normal(size=(m, rank)) @ r.normal(size=(rank, n))
    if name == "empty_blocks":
        a[20:44] = 0
    b = r.normal(size=(m, 2))
    f = reflectors.factor(sources.matrix_from(spark, a), fan, rows)
    q = sources.to_numpy(f.q())
    assert np.abs(q.T @ q - np.eye(len(f.r))).max() < 1e-12
    assert np.allclose(q @ f.r, a) and np.allclose(np.tril(f.r, -1), 0) and (np.diag(f.r) >= 0).all()
    assert np.allclose(f.transposed_times(sources.matrix_from(spark, b)), q.T @ b)
    c = r.normal(size=(len(f.r), 3))
    assert np.allclose(sources.to_numpy(f.times(c)), q @ c)


def graded(m, n, condition, seed=6):
    r = np.random.default_rng(seed)
    u, _ = np.linalg.qr(r.normal(size=(m, n)))
    v, _ = np.linalg.qr(r.normal(size=(n, n)))
    return u * np.geomspace(1, 1 / condition, n) @ v.T


def test_q_is_orthogonal_whatever_the_condition(spark):
    a = graded(80, 6, 1e10)
    q, r = direct.qr(sources.matrix_from(spark, a))
    q = sources.to_numpy(q)
    assert np.abs(q.T @ q - np.eye(6)).max() < 1e-12 and np.allclose(q @ r, a, atol=1e-14)
    u, s, v = spectral.svd(sources.matrix_from(spark, a))
    u = sources.to_numpy(u)
    assert np.abs(u.T @ u - np.eye(6)).max() < 1e-12 and np.allclose(s, np.geomspace(1, 1e-10, 6), rtol=1e-4)


def test_least_squares(spark):
    for a in (graded(60, 5, 1e6), np.hstack([graded(60, 3, 10), np.zeros((60, 1))])):
        b = np.random.default_rng(7).normal(size=60)
        got = sources.to_numpy(direct.least_squares(sources.matrix_from(spark, a), sources.vector_from(spark, b)))
        assert np.allclose(got, np.linalg.lstsq(a, b, rcond=1e-12)[0], rtol=1e-6, atol=1e-8)


def test_no_entries(spark):
    none = Mat(sources.zero_matrix(spark, 5, 3).df.limit(0), 5, 3)
    f = reflectors.factor(none)
    assert f.r.shape == (0, 3) and f.transposed_times(sources.matrix_from(spark, np.ones((5, 2)))).shape == (0, 2)
    assert spectral.svd(none)[1].tolist() == [0, 0, 0]
    assert bidiagonal.svd(none)[1].tolist() == [0, 0, 0]


@pytest.mark.parametrize("limit", [types.LOCAL_ENTRIES, 0])
@pytest.mark.parametrize("rank", [6, 3])
def test_bidiagonal_form(spark, monkeypatch, limit, rank):
    """By the triangular factor, and by products with a matrix whose square of columns is too large for one task."""
    r = np.random.default_rng(8)
    a = r.normal(size=(40, rank)) @ r.normal(size=(rank, 6))
    m = sources.matrix_from(spark, a)
    monkeypatch.setattr(bidiagonal, "LOCAL_ENTRIES", limit)
    u, d, e, v = bidiagonal.bidiagonalise(m)
    u = sources.to_numpy(u)
    assert np.allclose(u @ (np.diag(d) + np.diag(e, 1)) @ v.T, a)
    assert np.abs(u.T @ u - np.eye(6)).max() < 1e-12 and np.abs(v.T @ v - np.eye(6)).max() < 1e-12
    u, s, v = bidiagonal.svd(m)
    assert np.allclose(s, np.linalg.svd(a, compute_uv=False)) and np.allclose(sources.to_numpy(u) * s @ v.T, a)


@pytest.mark.parametrize("d, e", [([1, 0, 3, 0], [2, 5, 1]), ([0, 0, 0], [1, 1]), ([1, -2, 3], [0, 0]), ([1e-9, 1, 1e9], [1, 1]), ([2.0], []), ([], []), ([3, 3, 3, 3], [1e-30, 1, 1])])
def test_rotations(d, e):
    b = np.diag(np.array(d, float)) + np.diag(np.array(e, float), 1) if d else np.zeros((0, 0))
    s, x, y = bidiagonal.diagonalise(np.array(d, float), np.array(e, float))
    top = max(1.0, np.abs(b).max(initial=0))
    assert np.allclose(s, np.linalg.svd(b, compute_uv=False), atol=1e-14 * top) and np.allclose(x * s @ y.T, b, atol=1e-14 * top)
    assert np.allclose(x.T @ x, np.eye(len(d))) and np.allclose(y.T @ y, np.eye(len(d)))


def parted():
    """A tall part, a wide one of rank 2, a chain and a single entry among rows and columns without entries."""
    r = np.random.default_rng(5)
    a = np.zeros((64, 40))
    rows, cols = r.permutation(64), r.permutation(40)
    a[np.ix_(rows[:23], cols[:5])] = r.normal(size=(23, 5))
    a[np.ix_(rows[23:27], cols[5:16])] = r.normal(size=(4, 2)) @ r.normal(size=(2, 11))
    for k in range(12):
        a[rows[30 + k], cols[16 + k : 18 + k]] = 1 + k, 2
    a[rows[50], cols[30]] = -3
    return a


@pytest.mark.parametrize("cells", [bidiagonal.PART_CELLS, 60, 0])
def test_svd_of_connected_parts(spark, monkeypatch, cells):
    """In the tasks, or by the form for large parts; the matrix has more columns than its square may have for one task."""
    a = parted()
    monkeypatch.setattr(bidiagonal, "PART_CELLS", cells)
    monkeypatch.setattr(bidiagonal, "LOCAL_ENTRIES", 200)
    monkeypatch.setattr(bidiagonal, "DRIVER_ROWS", 100)

    def cells_of(rows, u, s, cols, v):
        x = (u * s) @ v.T
        return np.repeat(rows, len(cols)), np.tile(cols, len(rows)), x.ravel()

    m = sources.matrix_from(spark, a)
    got = bidiagonal.svd_parts(m, cells_of, "i long, j long, v double").toPandas()
    again = np.zeros(a.shape)
    np.add.at(again, (got["i"], got["j"]), got["v"])
    assert np.allclose(again, a, atol=1e-12) and not got.duplicated(["i", "j"]).any()
    if cells:
        # a part's values come with each of its pieces
        found = bidiagonal.svd_parts(m, lambda rows, u, s, cols, v: (s,), "s double").toPandas()["s"]
        distinct = lambda x: np.unique(np.round(x[x > 1e-9], 8))
        assert np.allclose(distinct(found), distinct(np.linalg.svd(a, compute_uv=False)))


def test_columns_are_linked_through_rows(spark):
    a = parted()
    label = bidiagonal._columns_linked(sources.matrix_from(spark, a))
    linked = (a.T != 0).astype(int) @ (a != 0) > 0
    for _ in range(6):
        linked = (linked.astype(int) @ linked) > 0
    assert all(label[k] == min(np.flatnonzero(linked[k]), default=k) for k in range(40))


@pytest.mark.parametrize("step", [1, 3, 7, 100])
def test_dense_svd(step):
    a = graded(23, 5, 1e8)
    i, j = np.indices(a.shape)
    u = np.zeros(a.shape)
    for k, rows, s, v in bidiagonal.dense_svd(i.ravel(), j.ravel(), a.ravel(), 23, 5, step):
        u[k : k + len(rows)] = rows
    assert np.allclose(u * s @ v.T, a, atol=1e-14) and np.abs(u.T @ u - np.eye(5)).max() < 1e-12 and np.abs(v.T @ v - np.eye(5)).max() < 1e-12
    assert np.allclose(s, np.geomspace(1, 1e-8, 5), rtol=1e-6)


@pytest.mark.parametrize("kind", ["lower", "upper"])
def test_waves_leave_no_table_on_the_driver(spark, monkeypatch, kind):
    """The ranges of a wave are chosen by a condition: each broadcast join would leave its table there."""
    n = 30
    a = np.eye(n) * 9 + np.tri(n, k=-1) * (np.add.outer(np.arange(n), np.arange(n)) % 4 == 0)
    a = a if kind == "lower" else a.T
    monkeypatch.setattr(substitution.blocks, "CHUNK", 8)
    monkeypatch.setattr(substitution.F, "broadcast", lambda df: pytest.fail("a broadcast join"))
    x = np.arange(n) % 7 + 1.0
    m = sources.matrix_from(spark, a)
    got = substitution.substitute(m, sources.matrix_from(spark, (a @ x)[:, None]), kind)
    assert np.allclose(sources.to_numpy(got)[:, 0], x)
    level = np.zeros(n, int)
    for k in range(n) if kind == "lower" else range(n)[::-1]:
        level[k] = max((level[c] + 1 for c in np.flatnonzero(a[k]) if c != k), default=0)
    assert substitution.levels(m, kind).orderBy("i").toPandas()["level"].tolist() == level.tolist()


def executions(spark):
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


@pytest.mark.parametrize("pre", [False, True])
def test_one_action_an_iteration(spark, monkeypatch, pre):
    monkeypatch.setattr(types, "DRIVER_ROWS", 0)
    a = sources.laplace_2d(spark, 4, 3)
    x = np.arange(12) % 7 + 1.0
    b = sources.vector_from(spark, sources.to_numpy(a) @ x)
    half = (lambda r: r.withColumn("v", F.col("v") / 4)) if pre else None
    seen, steps = [], []

    def monitor(k, error):
        seen.append(executions(spark))
        steps.append(error)
        return False

    got = solvers.cg(a, b, preconditioner=half, monitor=monitor)
    assert np.allclose(sources.to_numpy(got.x), x, atol=1e-6) and len(seen) == got.iterations > 3
    assert np.diff(seen).tolist() == [1] * (len(seen) - 1)
    seen.clear()
    got = solvers.bicgstab(a, b, preconditioner=half, monitor=monitor)
    assert np.allclose(sources.to_numpy(got.x), x, atol=1e-6)
    assert np.diff(seen).tolist() == [2] * (len(seen) - 1)
    assert solvers.cg(a, sources.zero_vector(spark, 12)).iterations == 0


@pytest.mark.parametrize("kind", ["lower", "upper"])
@pytest.mark.parametrize("width", [1, 3])
def test_no_vector_comes_to_the_driver(spark, monkeypatch, kind, width):
    """A strip leaves its solution in the shared folder; the driver sees numbers of strips only. Two parts without links."""
    n = 40
    t = sparse_triangle(n, 0.3) * (np.arange(n)[:, None] // 20 == np.arange(n) // 20)
    t = t if kind == "lower" else t.T.copy()
    x = np.random.default_rng(3).normal(size=(n, width))
    m, b = sources.matrix_from(spark, t), sources.matrix_from(spark, t @ x)
    monkeypatch.setattr(substitution.blocks, "CHUNK", 60)
    with monkeypatch.context() as at:
        for name in ("to_array", "on_arrays", "laid_out"):
            at.setattr(substitution, name, lambda *a, **k: pytest.fail("a vector on the driver"))
        at.setattr(type(m.df), "toArrow", lambda self: pytest.fail("a table on the driver"))
        got = substitution.substitute(m, b, kind)
    assert np.allclose(sources.to_numpy(got), x)


def test_ranges_end_where_parts_do():
    linked = [(5, 7, 0), (5, 7, 0), (5, 7, 6), (5, 7, 8), (5, 14, 0), (5, 14, 0), (5, 14, 0), (5, 15, 0)]
    assert substitution._cut(linked, 2, 100, 16) == [0, 8]
    assert substitution._cut(linked, 2, 10, 16) == [0, 4, 8, 12]
    assert substitution._cut([(5, 15, 0)] * 8, 2, 1000, 16) == [0]
    assert substitution._cut([(5, 3, 0), (5, 4, 3), (5, 9, 5), (5, 9, 0), (5, 9, 10)], 2, 8, 10) == [0, 2, 4, 5, 6, 8]
