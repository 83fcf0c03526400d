"""Registered queries against their SQL, and operators on odd inputs."""

import math
import re

import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"
FAST = r"^(el_(erfc?|log|trunc|div|fmod|eq|cast_ulong|cast_float)$|vec_|agg_|scan_|mat_(row|diag|slice|axpby)|sp_row_info|sp_trsv|sp_block_trsv|sp_trsm|level_sched|qr_|bidiag|long_fft|stl_solve|top_eig|lanczos_invit|dft_definition|fft_reorder|cg_tables|io_(copy_|set|mm|interop)|gen_|gemv$|gemm_(tn|blocked)|spmv_hyb|spgemm|prod_(circ|toep|hank|vand)|trsv_lower$|trsm_(unit_upper_t_bt|lower)$|lu$|qr_recover|lstsq|eig_|tridiag|svd|nmf|fft2|convolve$|permute|cg$|pc_(jacobi|ilut|ilu0|amg_smoothed|chow_patel_icc)$|amg_|smooth_jacobi|reorder_)"
#: The other solver queries, which take longer.
SLOW = "bicgstab gmres pc_amg pc_amg_direct".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _names():
    from axolin import catalog

    return [n for n in catalog.SQL if re.match(FAST, n)]


@pytest.mark.parametrize("name", _names())
def test_query_matches_sql(spark, duck, name):
    from axolin import catalog

    def table(df):
        plain = lambda v: None if v is None or v != v else round(v, 3) + 0.0 if isinstance(v, float) else v
        return sorted(tuple(plain(v.item() if hasattr(v, "item") else v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))

    got, want = table(catalog.Q[name](spark, DATA).toPandas()), table(duck.execute(catalog.SQL[name]).fetchdf())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-3)) for x, y in zip(a, b, strict=True))


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_ieee_results(spark):
    from axolin.operators.vector import binary, unary

    x = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, -1.0), (3, 0.0)], "i long, v double")
    y = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 0.0), (3, 2.0)], "i long, v double")
    div = {r.i: r.v for r in binary(x, y, "div").collect()}
    assert div[0] == math.inf and math.isnan(div[1]) and div[2] == -math.inf and div[3] == 0
    log = {r.i: r.v for r in unary(x, "log").collect()}
    assert log[0] == 0 and log[1] == -math.inf and math.isnan(log[2])


def test_shapes_are_checked(spark):
    from axolin import sources
    from axolin.operators import direct, product, vector

    a, x = sources.laplace_2d(spark, 3, 2), sources.unit_vector(spark, 4, 0)
    for bad in (lambda: product.gemv(a, x), lambda: vector.part(x, 2, 9), lambda: vector.strided(x, 0, 0, 1), lambda: product.circulant(x, sources.unit_vector(spark, 5, 0))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ZeroDivisionError):
        direct.trsv(sources.zero_matrix(spark, 4, 4), x)


def test_empty_inputs(spark):
    from axolin.operators import vector

    none = spark.createDataFrame([], "i long, v double")
    assert vector.reduce(none, "max").first().v is None and vector.index_norm_inf(none).first().i is None
    assert vector.scan(none).count() == 0 and vector.axpby(1, none, 1, none).count() == 0


def test_market_reader(spark, tmp_path):
    from axolin import sources

    f = tmp_path / "m.mtx"
    f.write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n1 1 2.0\n3 1 5\n3 1 7\n")
    m = sources.read_matrix_market(spark, str(f))
    assert sorted(map(tuple, m.df.collect())) == [(0, 0, 2.0), (0, 2, 7.0), (2, 0, 7.0)] and (m.m, m.n) == (3, 3)
    f.write_text("%%MatrixMarket matrix array real general\n1 1\n1\n")
    with pytest.raises(ValueError):
        sources.read_matrix_market(spark, str(f))


def test_monitor_and_start(spark):
    from axolin import sources
    from axolin.operators.product import gemv
    from axolin.plans import solvers

    a = sources.laplace_2d(spark, 3, 2)
    ones = sources.scalar_vector(spark, 6, 1.0)
    b = gemv(a, ones)
    assert solvers.cg(a, b, x0=ones).iterations == 0
    seen = []
    assert solvers.cg(a, b, monitor=lambda k, e: seen.append(k) or k == 1).iterations == 1 and seen == [1]
    assert solvers.cg(a, sources.zero_vector(spark, 6)).iterations == 0


@pytest.mark.parametrize("name", ["cg_gram", "bicgstab_gram", "gmres_gram", "pc_jacobi_gram", "pc_block_ilu_gram", "pc_amg_gram", *SLOW])
def test_whole_table_query_matches_sql(spark, duck, name):
    test_query_matches_sql(spark, duck, name)
