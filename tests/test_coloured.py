"""Factors by colours against the sequential elimination in the same order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axolin import sources, types
from axolin.plans import blocks, coloured, precondition, solvers


def pattern(n, share, seed):
    r = np.random.default_rng(seed)
    a = r.normal(size=(n, n)) * (r.random((n, n)) < share)
    a = np.where(np.abs(a) + np.abs(a.T) > 0, a, 0)
    return a + np.diag(np.abs(a).sum(axis=1) + 1)


@pytest.mark.parametrize("few", [blocks.FEW, 0])
def test_colours(spark, monkeypatch, few):
    monkeypatch.setattr(blocks, "FEW", few)
    for a in (pattern(40, 0.1, 1), pattern(12, 0.9, 2), np.eye(5)):
        c = coloured.colours(sources.matrix_from(spark, a))
        i, j = np.nonzero(a)
        assert all(c[i[i != j]] != c[j[i != j]]) and sorted(set(c)) == list(range(c.max() + 1))
    grid = sources.laplace_2d(spark, 16, 12)
    assert coloured.colours(grid).max() <= 3


def sequential(a, order):
    """ILU0 row by row of the permuted matrix."""
    m = a[np.ix_(order, order)]
    rows = [{j: m[i, j] for j in np.flatnonzero(m[i])} for i in range(len(m))]
    out = np.zeros(m.shape)
    for i, row in enumerate(precondition.factor_ilu0(rows)):
        for j, v in row.items():
            out[i, j] = v
    return out


@pytest.mark.parametrize("share", [0.08, 0.4])
def test_factors_are_the_sequential_ones(spark, share):
    a = pattern(30, share, 3)
    m = sources.matrix_from(spark, a)
    c = coloured.colours(m)
    cells, place = coloured.factor(m, c)
    assert np.allclose(sources.to_numpy(types.Mat(cells, 30, 30)), sequential(a, np.argsort(place)), atol=1e-12)
    with pytest.raises(ValueError):
        coloured.factor(m, np.zeros(30, int))


def test_rows_of_a_colour_are_eliminated_in_several_tasks(spark):
    a = sources.laplace_2d(spark, 12, 10)
    cells, _ = coloured.factor(a, coloured.colours(a))
    assert cells.where("i >= 60").select(F.spark_partition_id()).distinct().count() > 1


def test_preconditioner(spark):
    cells = spark.range(130).select(F.col("id").alias("i"), (1.0 + F.col("id") * 7 % 5).alias("v"))
    a = sources.diffusion_2d(cells, 13, 10)
    x = np.arange(a.n) % 7 + 1.0
    b = sources.vector_from(spark, sources.to_numpy(a) @ x)
    for kind in ("ilu0", "ichol0"):
        p = coloured.incomplete(a, kind)
        plain, got = solvers.cg(a, b), solvers.cg(a, b, preconditioner=p)
        assert np.allclose(sources.to_numpy(got.x), x, atol=1e-5) and got.iterations < 0.75 * plain.iterations
    assert np.allclose(p.arrays(x), blocks.to_array(p(blocks.to_frame(spark, x)), a.n))


def test_bad_pivots(spark):
    a = sources.matrix_from(spark, np.array([[0.0, 1.0], [1.0, 2.0]]))
    for order in ([0, 1], [1, 0]):
        try:
            cells, place = coloured.factor(a, np.array(order))
        except ZeroDivisionError:
            break
        except Exception as e:  # raised within a task
            assert "zero pivot" in str(e)
            break
    else:
        raise AssertionError
    with pytest.raises(ZeroDivisionError):
        coloured.incomplete(sources.matrix_from(spark, np.diag([1.0, -1.0])), "ichol0")
