"""Orderings against sequential versions on graphs of several components, and products with heavy contraction indices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axolin import sources, types
from axolin.operators import matrix, product
from axolin.plans import blocks, reorder, solvers
from axolin.types import Mat


def graph(n, share, seed, parts=1):
    """A random pattern, in parts that are not linked; the last two nodes are alone."""
    r = np.random.default_rng(seed)
    a = r.random((n, n)) < share
    i, j = np.indices((n, n))
    a &= (i % parts == j % parts) & (i < n - 2) & (j < n - 2)
    return (a | a.T) & ~np.eye(n, dtype=bool)


def sequential(near):
    """Cuthill-McKee, one node at a time."""
    n = len(near)
    key = lambda k: (near[k].sum(), k)
    seen, order = set(), []
    for root in sorted(range(n), key=key):
        if root in seen:
            continue
        seen.add(root)
        queue = [root]
        while queue:
            k = queue.pop(0)
            order.append(k)
            for y in sorted(np.flatnonzero(near[k]), key=key):
                if y not in seen:
                    seen.add(y)
                    queue.append(int(y))
    return order


GRAPHS = {"one": (30, 0.08, 1, 1), "sparse": (40, 0.03, 2, 1), "parts": (42, 0.2, 3, 3), "alone": (6, 0.0, 4, 1)}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("few", [blocks.FEW, 0])
def test_breadth_first_places(spark, monkeypatch, name, few):
    near = graph(*GRAPHS[name])
    monkeypatch.setattr(blocks, "FEW", few)
    a = sources.matrix_from(spark, near.astype(float) + np.eye(len(near)))
    got = [r.i for r in reorder.cuthill_mckee(a).orderBy("p").collect()]
    assert got == sequential(near)


def width(near, order):
    at = np.argsort(order)
    i, j = np.nonzero(near)
    return int(np.abs(at[i] - at[j]).max(initial=0))


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("method", [reorder.advanced_cuthill_mckee, reorder.gibbs_poole_stockmeyer])
def test_other_orderings(spark, name, method):
    near = graph(*GRAPHS[name])
    a = sources.matrix_from(spark, near.astype(float) + np.eye(len(near)))
    got = [r.i for r in method(a).orderBy("p").collect()]
    assert sorted(got) == list(range(len(near)))
    if method is reorder.advanced_cuthill_mckee:
        assert width(near, got) <= width(near, sequential(near))
    else:
        assert width(near, got) <= max(1, int(1.3 * width(near, sequential(near))))


def test_a_long_path(spark):
    """A path in a random order gets its order back from every method."""
    p = np.random.default_rng(5).permutation(50)
    near = np.zeros((50, 50))
    near[p[:-1], p[1:]] = near[p[1:], p[:-1]] = 1
    a = sources.matrix_from(spark, near)
    for method in (reorder.cuthill_mckee, reorder.advanced_cuthill_mckee, reorder.gibbs_poole_stockmeyer):
        assert matrix.bandwidth(matrix.permute(a.df, method(a))).first()[0] == 1


def test_large_graphs_are_refused(spark, monkeypatch):
    monkeypatch.setattr(types, "DRIVER_ROWS", 3)
    with pytest.raises(ValueError):
        reorder.cuthill_mckee(sources.identity_matrix(spark, 4))


def heavy_pair(share):
    """Factors in which one contraction index has that share of both."""
    r = np.random.default_rng(6)
    a, b = (r.random((60, 40)) < 0.02).astype(float), (r.random((40, 50)) < 0.02).astype(float)
    a[:, 7] = r.random(60) < share
    b[7] = r.random(50) < share
    return a * r.normal(size=a.shape), b * r.normal(size=b.shape)


@pytest.mark.parametrize("share", [0.0, 0.9])
@pytest.mark.parametrize("heavy", [4, 64])
def test_heavy_products(spark, share, heavy):
    a, b = heavy_pair(share)
    got = product.spgemm(sources.matrix_from(spark, a), sources.matrix_from(spark, b), heavy)
    assert np.allclose(sources.to_numpy(got), a @ b)
    none = Mat(sources.matrix_from(spark, a).df.limit(0), 60, 40)
    assert product.spgemm(none, sources.matrix_from(spark, b)).df.count() == 0


def test_a_heavy_index_is_dealt_out(spark):
    """A third of the entries has one contraction index: no group of the join has more than a few times its share."""
    n = 6000
    a = Mat(spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997 + 1).cast("bigint").alias("j"), F.lit(1.0).alias("v")), n, 998)
    b = Mat(spark.range(998).select(F.col("id").alias("i"), F.lit(0).cast("bigint").alias("j"), F.lit(1.0).alias("v")), 998, 1)
    got = product.spgemm(a, b)
    assert got.df.agg(F.sum("v")).first()[0] == n
    plan = got.df._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(i" in plan
    # the shares that the operator deals index 0 to
    shares = -(-n // 3 * product.HEAVY // n)
    sizes = [r["count"] for r in a.df.where("j = 0").groupBy(F.pmod(F.xxhash64("i"), F.lit(shares))).count().collect()]
    assert len(sizes) == shares and max(sizes) < 2 * sorted(sizes)[shares // 2]


def test_reflections_make_an_orthogonal_basis(spark):
    r = np.random.default_rng(7)
    u, _ = np.linalg.qr(r.normal(size=(30, 30)))
    v, _ = np.linalg.qr(r.normal(size=(30, 30)))
    d = u * np.geomspace(1, 1e-10, 30) @ v.T
    x = r.normal(size=30)
    a, b = sources.matrix_from(spark, d), sources.vector_from(spark, d @ x)
    got = solvers.gmres(a, b, tol=1e-13, krylov=30, reflections=True)
    assert got.iterations <= 30 and np.linalg.norm(d @ sources.to_numpy(got.x) - d @ x) < 1e-12 * np.linalg.norm(d @ x)
    s = np.diag(np.arange(1.0, 31)) + np.diag(np.ones(29), 1)
    for flag in (False, True):
        got = solvers.gmres(sources.matrix_from(spark, s), sources.vector_from(spark, s @ x), krylov=8, reflections=flag, preconditioner=lambda q: q.withColumn("v", F.col("v") / (F.col("i") + 1)))
        assert np.allclose(sources.to_numpy(got.x), x, atol=1e-7)
    seen = []
    assert solvers.gmres(a, b, reflections=True, monitor=lambda k, e: seen.append(k) or k == 3).iterations == 3 and seen == [1, 2, 3]
