"""What comes to the driver or goes through a shuffle stays bounded where graphs, triangles and results are large."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from axolin import catalog, sources, types
from axolin.operators import direct, matrix, product, substitution
from axolin.plans import blocks, multigrid, reorder
from axolin.types import Mat, Vec


@pytest.fixture
def sent(monkeypatch):
    """How many numbers each job over packed chunks gave to the driver."""
    seen, each = [], blocks.Chunks.each

    def counted(self, fn, *arrays):
        got = each(self, fn, *arrays)
        seen.append(sum(len(x[0]) for x in got))
        return got

    monkeypatch.setattr(blocks, "FEW", 0)
    monkeypatch.setattr(blocks, "CHUNK", 60)
    monkeypatch.setattr(blocks.Chunks, "each", counted)
    return seen


def dense_graph(n=40):
    near = np.random.default_rng(0).random((n, n)) < 0.5
    return ((near | near.T) & ~np.eye(n, dtype=bool)).astype(float)


def check_ordering(spark, sent, method):
    """A layer with many entries gives a number a node (and chunk that a row is cut by), not one for each chunk and node."""
    near = dense_graph()
    order = method(sources.matrix_from(spark, near), symmetric=True)
    assert sorted(r.p for r in order.collect()) == list(range(len(near)))
    assert sent and max(sent) <= 1.5 * len(near)


def test_layers_of_cuthill_mckee(spark, sent):
    check_ordering(spark, sent, reorder.cuthill_mckee)


def test_tables_of_arrays(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PIECE", 4)
    got = blocks.to_table(spark, "i long, p int, v double", np.arange(10), np.arange(10) * 2, np.arange(10) / 4).collect()
    assert sorted(map(tuple, got)) == [(k, 2 * k, k / 4) for k in range(10)]
    x = np.arange(10) / 8
    assert blocks.to_array(blocks.to_frame(spark, x), 10).tolist() == x.tolist()


def test_permuting_with_a_broadcast(spark):
    near = dense_graph(12)
    a = sources.matrix_from(spark, near)
    p = spark.createDataFrame([(k, 11 - k) for k in range(12)], "i long, p long")
    assert sorted(matrix.permute(a.df, p, 12).collect()) == sorted(matrix.permute(a.df, p).collect())


@pytest.fixture
def waves(spark, monkeypatch):
    """The broadcasts of a substitution: one of the diagonal and one for each wave."""
    seen, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: seen.append(1) or broadcast(self, x))
    return seen


def chain(n=48):
    return np.tril(np.random.default_rng(1).random((n, n)) < 0.2, -1) + np.diag(np.full(n - 1, 0.5), -1) + 2 * np.eye(n)


@pytest.mark.parametrize("kind", ["lower", "upper"])
def test_waves_are_no_more_than_ranges(spark, waves, kind):
    """A chain of 48 levels in ranges of some 60 entries."""
    t = chain() if kind == "lower" else chain().T[::-1, ::-1].T.copy()
    x = np.arange(48.0)[:, None]
    got, level = substitution.on_arrays(sources.matrix_from(spark, t).df.where("i != j"), kind == "lower", np.diag(t), t @ x, 60)
    assert np.allclose(got, x) and level.max() == 47
    entries = np.count_nonzero(t) - 48
    assert 2 <= len(waves) <= 2 + entries // 60


def one_file(spark, n):
    return Vec(spark.range(n).coalesce(1).select(F.col("id").alias("i"), (F.col("id") * 0.37 - 1).alias("v")), n)


def test_outer_product_of_one_file_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(types, "TASK_CELLS", 100)
    got = product.outer(one_file(spark, 40), one_file(spark, 40)).df
    x = np.arange(40) * 0.37 - 1
    assert got.rdd.getNumPartitions() > 4 and np.allclose(sources.to_numpy(types.Mat(got, 40, 40)), np.outer(x, x))


@pytest.mark.parametrize("kind", ["circulant", "vandermonde"])
def test_structured_entries_of_one_file_are_dealt_out(spark, monkeypatch, kind):
    monkeypatch.setattr(types, "TASK_CELLS", 100)
    got = product.structured(one_file(spark, 40), kind).df
    assert got.rdd.getNumPartitions() > 4 and got.count() == 1600


@pytest.mark.parametrize("digits", [2, 6])
def test_rounding_is_that_of_decimals(spark, digits):
    r = np.random.default_rng(3)
    whole = np.arange(-300, 300)
    some = [*(whole / 8), *((whole + 0.5) / 10**digits), *(r.normal(size=300) * 10.0 ** r.integers(-12, 18, 300)), 0.0, -0.0, np.inf, -np.inf, np.nan]
    df = spark.createDataFrame([(float(v),) for v in some], "v double")
    got = df.select(catalog.near("v", digits, "double").alias("a"), F.round("v", digits).alias("b")).collect()
    assert all(x.a == x.b or (x.a != x.a and x.b != x.b) for x in got)


def test_dense_places_are_not_shuffled(spark):
    """Only A's own rows go through an exchange; the zeros of a row are counted through."""
    r = np.random.default_rng(4)
    a = (r.random((9, 30)) < 0.2) * r.normal(size=(9, 30))
    a[3], a[4] = 0, 1.5
    m, x, y = sources.matrix_from(spark, a), r.normal(size=9), r.normal(size=30)
    m = types.Mat(m.df.where("v != 0"), 9, 30)
    for made in (matrix.dense(m), product.ger(m, 0.5, sources.vector_from(spark, x), sources.vector_from(spark, y))):
        assert made.df.count() == 270 and "FullOuter" not in made.df._jdf.queryExecution().optimizedPlan().toString()
    assert np.allclose(sources.to_numpy(matrix.dense(m)), a)
    assert np.allclose(sources.to_numpy(made), a + 0.5 * np.outer(x, y))


def test_dense_grid_meets_no_join(spark):
    m = types.Mat(sources.matrix_from(spark, np.eye(6)).df.where("v != 0"), 6, 6)
    seen = str(matrix.dense(m).df._jdf.queryExecution().optimizedPlan().toString())
    assert "(j#" not in "".join(line for line in seen.splitlines() if "Join" in line)


@pytest.mark.parametrize("symmetric", [True, False])
def test_aggregation_of_many_entries(spark, monkeypatch, symmetric):
    """Beyond the bound of one task the roots are those of the sequential order, and at most two steps away."""
    n = 70
    near = np.random.default_rng(8).random((n, n)) < 0.025
    near = (near | near.T if symmetric else near) & ~np.eye(n, dtype=bool)
    root = np.full(n, -1)
    for k in range(n):
        if root[k] < 0 and (root[near[k]] < 0).all():
            root[k] = k
            root[near[k]] = k
    first = root.copy()
    for k in np.flatnonzero(root < 0):
        root[k] = first[[x for x in np.flatnonzero(near[k]) if first[x] >= 0][0]]
    a = sources.matrix_from(spark, near.astype(float) + np.eye(n))
    a = types.Mat(a.df.where("v != 0"), n, n)
    for bound in (multigrid.LOCAL_ENTRIES, 10):
        monkeypatch.setattr(multigrid, "LOCAL_ENTRIES", bound)
        got = {r.i: r.root for r in multigrid.aggregate_sequential(a, symmetric).collect()}
        assert [got[k] for k in range(n)] == root.tolist()


def test_products_move_factors_only(spark, monkeypatch):
    """Shares of rows and columns: what goes through a shuffle are entries of the factors, and no products."""
    monkeypatch.setattr(product, "SHARE", 50)
    monkeypatch.setattr(product, "PIECE", 64)
    r = np.random.default_rng(9)
    a, b = ((r.random(s) < 0.2) * r.normal(size=s) for s in ((60, 8), (8, 70)))
    sparse = lambda x: types.Mat((m := sources.matrix_from(spark, x)).df.where("v != 0"), m.m, m.n)
    got = product.spgemm_shares(sparse(a), sparse(b))
    assert "Aggregate [i#" not in got.df._jdf.queryExecution().optimizedPlan().toString()
    want = (a != 0).astype(int) @ (b != 0).astype(int)
    rows = got.df.collect()
    assert len(rows) == len({(x.i, x.j) for x in rows}) == np.count_nonzero(want)
    assert np.allclose(sources.to_numpy(got), a @ b)


def test_sums_of_products_are_by_key(spark):
    i, j, v = product._multiplied(np.array([5, 5, 9]), np.array([1, 2, 1]), np.array([2.0, 3, 4]), np.array([1, 2, 2]), np.array([7, 7, 8]), np.array([1.0, 10, 100]))
    assert list(zip(i.tolist(), j.tolist(), v.tolist(), strict=True)) == [(5, 7, 32.0), (5, 8, 300.0), (9, 7, 4.0)]


def test_right_hand_sides_beyond_the_bound_go_in_passes(spark, monkeypatch):
    """Three columns of 48 rows, one at a time: no halves of the triangle."""
    monkeypatch.setattr(types, "DRIVER_ROWS", 60)
    monkeypatch.setattr(direct, "_block", None)
    x = np.arange(144.0).reshape(48, 3)
    got = direct.trsm(sources.matrix_from(spark, chain()), sources.matrix_from(spark, chain().T @ x), transposed=True)
    assert np.allclose(sources.to_numpy(got), x)


@pytest.mark.parametrize("method", [reorder.gibbs_poole_stockmeyer, reorder.advanced_cuthill_mckee])
def test_layers_of_other_orderings(spark, sent, method):
    check_ordering(spark, sent, method)


def test_product_with_an_array(spark, monkeypatch):
    """Sums by row within tasks and across them, in pieces of a few entries, with no join in the plan."""
    monkeypatch.setattr(product, "HELD", 5)
    a = np.arange(35.0).reshape(7, 5) % 4
    x = np.arange(10.0).reshape(5, 2) - 3
    m = Mat(sources.matrix_from(spark, a).df.repartition(3), 7, 5)
    got = product.times_array(m, x)
    assert "Join" not in got.df._jdf.queryExecution().toString()
    assert np.array_equal(sources.to_numpy(got), a @ x)
    assert np.array_equal(sources.to_numpy(product.times_array(m.T, np.arange(7.0))), (a.T @ np.arange(7.0))[:, None])
    with pytest.raises(ValueError):
        product.times_array(m, np.zeros(6))


def test_right_hand_sides_are_made_once(spark, monkeypatch):
    """Beyond the driver's bound columns are fetched one by one, of a table that is made only once."""
    monkeypatch.setattr(types, "DRIVER_ROWS", 20)
    t = np.tril(np.arange(144.0).reshape(12, 12) % 3) + 5 * np.eye(12)
    x, seen = np.arange(48.0).reshape(12, 4) % 7 + 1, spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    b = Mat(sources.matrix_from(spark, t @ x).df.mapInArrow(count, "i long, j long, v double"), 12, 4)
    assert np.allclose(sources.to_numpy(substitution.substitute(sources.matrix_from(spark, t), b)), x)
    assert seen.value == 48


def test_levels_are_laid_out_in_tasks(spark, monkeypatch):
    """No row of the result is made on the driver: places are counted in the tasks, also in an incomplete last piece."""
    monkeypatch.setattr(blocks, "PIECE", 4)
    t = np.tril(np.ones((10, 10)))
    got = substitution.levels(sources.matrix_from(spark, t))
    assert [tuple(r) for r in got.orderBy("i").collect()] == [(k, k) for k in range(10)]
    assert "Range" in got._jdf.queryExecution().toString()


def test_bandwidths_without_a_join(spark):
    """Of both orders in one pass over the entries; the places are an array in the tasks, no table for a join."""
    a = np.array([[0, 1.0, 0, 0], [1, 0, 0, 2], [0, 0, 3, 0], [0, 2, 0, 0]])
    p = spark.createDataFrame([(0, 0), (1, 1), (2, 3), (3, 2)], "i long, p long")
    got = matrix.bandwidths(Mat(sources.matrix_from(spark, a).df.where("v != 0"), 4, 4), p)
    assert "Join" not in got._jdf.queryExecution().toString()
    assert got.first() == (2, 1)
    assert matrix.bandwidths(Mat(sources.zero_matrix(spark, 4, 4).df.where("v != 0"), 4, 4), p).first() == (None, None)


def test_shares_of_entries_in_parts(spark, monkeypatch):
    """Entries of one place may come in parts, and rows of B are packed by ranges of columns."""
    monkeypatch.setattr(product, "SHARE", 9)
    monkeypatch.setattr(product, "PACKED", 4)
    monkeypatch.setattr(product, "OUT", 3)
    a, b = np.arange(42.0).reshape(6, 7) % 5, np.arange(77.0).reshape(7, 11) % 4
    twice = lambda m: Mat((d := sources.matrix_from(spark, m).df).unionByName(d), *m.shape)
    got = product.spgemm_shares(twice(a), twice(b))
    assert got.df.count() == got.df.select("i", "j").distinct().count()
    assert np.array_equal(sources.to_numpy(got), 4 * a @ b)


@pytest.mark.parametrize("most", [types.DRIVER_ROWS, 8])
def test_polynomials_at_many_points(spark, monkeypatch, most):
    """Points meet an array of coefficients and no table of them, as long as they fit the driver."""
    monkeypatch.setattr(types, "DRIVER_ROWS", most)
    e, x = np.linspace(-1, 0.9, 7), np.arange(9.0) % 4 - 1
    got = product.vandermonde(sources.vector_from(spark, e), sources.vector_from(spark, x))
    assert ("Join" in got.df._jdf.queryExecution().toString()) == (most == 8)
    assert np.allclose(sources.to_numpy(got), np.vander(e, 9, increasing=True) @ x)


def test_coefficients_without_a_value(spark):
    """They add nothing, and a point without a value has no result, as in a sum of products."""
    e, x = (spark.createDataFrame(rows, "i long, v double") for rows in ([(0, 2.0), (1, None)], [(0, 1.0), (1, None), (2, 3.0)]))
    got = product.vandermonde(Vec(e, 2), Vec(x, 3)).df.orderBy("i").collect()
    assert [tuple(r) for r in got] == [(0, 13.0), (1, None)]


@pytest.mark.parametrize("few", [0, 16])
def test_rows_of_a_product(spark, monkeypatch, few):
    """Entries, sums and largest values of rows, from shares of rows and columns; of places, also those without a value."""
    monkeypatch.setattr(product, "SHARE", 40)
    monkeypatch.setattr(product, "PIECE", 64)
    monkeypatch.setattr(product, "SUMMED", 300)
    monkeypatch.setattr(product, "BLOCK_CELLS", 50)
    monkeypatch.setattr(product, "FEW_INDICES", few)
    r = np.random.default_rng(9)
    a, b = ((r.random(s) < 0.4) * r.normal(size=s) for s in ((30, 8), (8, 70)))
    sparse = lambda x: Mat((m := sources.matrix_from(spark, x)).df.where("v != 0"), m.m, m.n)
    got = product.product_rows(sparse(a), sparse(b)).orderBy("i").collect()
    there, c = (a != 0).astype(int) @ (b != 0).astype(int) > 0, a @ b
    rows = np.flatnonzero(there.any(axis=1))
    assert [(x.i, x.entries) for x in got] == [(i, there[i].sum()) for i in rows]
    assert np.allclose([(x.total, x.top) for x in got], [(c[i].sum(), c[i][there[i]].max()) for i in rows])


def test_rows_of_a_product_with_nulls(spark):
    """A null row or column is one of its own, a null contraction index meets nothing and a null value adds nothing."""
    frame = lambda rows: spark.createDataFrame(rows, "i long, j long, v double")
    a = Mat(frame([(0, 0, 2.0), (0, 1, None), (1, 1, None), (None, 0, 3.0), (2, None, 1.0)]), 3, 2)
    b = Mat(frame([(0, 0, 1.0), (0, None, 5.0), (1, 1, -4.0), (None, 0, 9.0), (0, 0, None)]), 2, 2)
    got = product.product_rows(a, b).orderBy("i").collect()
    assert [tuple(x) for x in got] == [(None, 2, 18.0, 15.0), (0, 3, 12.0, 10.0), (1, 1, None, None)]
    entries = product.spgemm_shares(a, Mat(b.df.where("v IS NOT NULL"), 2, 2)).df.where("i IS NULL").orderBy("j").collect()
    assert [(x.j, x.v) for x in entries] == [(None, 15.0), (0, 3.0)]
    nan = Mat(frame([(0, 0, 1.0), (0, 1, float("nan"))]), 1, 2)
    assert str(product.product_rows(nan, Mat(frame([(0, 0, 1.0), (1, 0, 1.0)]), 2, 1)).first()[1:]) == "(1, nan, nan)"


def test_larger_factor_moves_once(spark):
    """Where few rows of B have nearly all entries its columns are dealt out, and no share of A's rows gets a copy of all."""
    a, b = (sources.matrix_from(spark, np.ones(s)) for s in ((5000, 2), (2, 300)))
    sizes = lambda p, q: pd.DataFrame({"n": [int(q["l"].map(len).sum())]})
    got = product._shares(a, b, 300_000, lambda _: sizes, "n long").collect()
    assert len(got) == 10 and sum(x.n for x in got) == 600
