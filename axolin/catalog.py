"""The registered queries of the linear-algebra operators and their DuckDB SQL.

Inputs are whole driver tables as vectors and matrices: x, y on parts, orders' and customers' values, A (orders x
parts) and B (parts x suppliers) from lineitem, E (the embeddings) and its Gram matrix G, and generated grids. Solvers
get right-hand sides made from a known solution, which is what their SQL returns. Values are rounded, as sums differ
in their last digits with the order of addition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axolin import blas, sources
from axolin.functions import CASTS, convert
from axolin.operators import direct, fourier, matrix, product, reflectors, substitution, vector
from axolin.plans import bidiagonal, coloured, jacobi, loop, multigrid, precondition, reorder, solvers, spectral
from axolin.types import Mat, Vec, driver_sized

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def size(df: DataFrame, key: str) -> int:
    return (df.agg(F.max(key)).first()[0] or 0) + 1


def vec(s, d, name, key, value) -> Vec:
    t = table(s, d, name)
    return Vec.of(t, key, value, size(t, key))


X = lambda s, d: vec(s, d, "part", "p_partkey", "p_retailprice")
Y = lambda s, d: vec(s, d, "part", "p_partkey", "p_size")
O = lambda s, d: vec(s, d, "orders", "o_orderkey", "o_totalprice")  # noqa: E731, E741
C = lambda s, d: vec(s, d, "customer", "c_custkey", "c_acctbal")
S = lambda s, d: vec(s, d, "supplier", "s_suppkey", "s_acctbal")


def A(s, d) -> Mat:
    return Mat.of(table(s, d, "lineitem"), "l_orderkey", "l_partkey", "l_quantity", size(table(s, d, "orders"), "o_orderkey"), size(table(s, d, "part"), "p_partkey"))


def B(s, d) -> Mat:
    return Mat.of(table(s, d, "lineitem"), "l_partkey", "l_suppkey", "l_quantity", size(table(s, d, "part"), "p_partkey"), size(table(s, d, "supplier"), "s_suppkey"))


def E(s, d) -> Mat:
    t = table(s, d, "embeddings")
    return sources.matrix_from_arrays(t, "vec_id", "embedding", size(t, "vec_id"), 64)


def G(s, d) -> Mat:
    g = spectral.gram(E(s, d))
    return Mat(loop.checkpoint(g.df), g.m, g.n)


WITH = {
    "x": "SELECT p_partkey AS i, p_retailprice AS v FROM part",
    "y": "SELECT p_partkey AS i, CAST(p_size AS DOUBLE) AS v FROM part",
    "o": "SELECT o_orderkey AS i, o_totalprice AS v FROM orders",
    "c": "SELECT c_custkey AS i, c_acctbal AS v FROM customer",
    "s": "SELECT s_suppkey AS i, s_acctbal AS v FROM supplier",
    "a": "SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2",
    "b": "SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2",
    "e": "SELECT vec_id AS i, k - 1 AS j, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(k)",
    "g": "SELECT p.j AS i, q.j AS j, sum(p.v * q.v) AS v FROM e p JOIN e q ON p.i = q.i GROUP BY 1, 2",
    "np": "SELECT max(p_partkey) + 1 AS n FROM part",
}


def near(c: str, digits: int, kind: str):
    """round(c, digits): by a division where the digit after is clearly under or over a half and the value has digits
    to spare, which gives the same number; Spark's own way goes through decimals."""
    if kind == "float":
        return F.round(c, digits)
    unit = 10.0**digits
    t = F.abs(c) * unit
    k = F.floor(t + 0.5).cast("double")
    return F.when((t < 1e11) & (F.abs(k - t) < 0.499), F.when(F.col(c) < 0, -k).otherwise(k) / unit).otherwise(F.round(c, digits))


def rounded(df: DataFrame, digits: int = 4, *names: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[(near(c, digits, kinds[c]) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "float") and (not names or c in names) else F.col(c) for c in df.columns])


def R(c: str, digits: int = 4) -> str:
    return f"round({c}, {digits}) + 0.0"


def add(name: str, run, sql: str | None = None, uses: str = "") -> None:
    Q[name] = run
    if sql is not None:
        parts = ", ".join(f"{u} AS ({WITH[u]})" for u in uses.split())
        SQL[name] = (f"WITH {parts} " if parts else "") + sql


def as_vec(fn, digits: int = 4):
    return lambda s, d: rounded(fn(s, d), digits)


# ---- element-wise functions -------------------------------------------------------------------------------------
UNIT, POSITIVE = "(p_size - 25.5e0) / 25.5e0", "p_size / 10e0"
_ERF = "2 / sqrt(pi()) * list_sum(list_transform(range(31), lambda n: pow(-1, n) * pow({v}, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))"
UNARY_SQL = {
    "abs": "abs({v})", "acos": "acos({v})", "acosh": "acosh({v} + 1)", "asin": "asin({v})", "asinh": "asinh({v})", "atan": "atan({v})", "atanh": "atanh({v})",
    "ceil": "ceil({v})", "cos": "cos({v})", "cosh": "(exp({v}) + exp(-({v}))) / 2", "erf": _ERF, "erfc": f"1 - {_ERF}", "exp": "exp({v})", "exp2": "pow(2, {v})", "exp10": "pow(10, {v})",
    "fabs": "abs({v})", "floor": "floor({v})", "log": "ln({v})", "log2": "log2({v})", "log10": "log10({v})", "round": "round({v})", "rsqrt": "pow({v}, -0.5)",
    "sign": "CAST(sign({v}) AS DOUBLE)", "sin": "sin({v})", "sinh": "(exp({v}) - exp(-({v}))) / 2", "sqrt": "sqrt({v})", "tan": "tan({v})", "tanh": "1 - 2 / (exp(2 * ({v})) + 1)", "trunc": "trunc({v})", "neg": "-({v})",
}


def _unary(name: str) -> None:
    base = POSITIVE if name in ("acosh", "log", "log2", "log10", "rsqrt", "sqrt") else UNIT
    shift = 1.0 if name == "acosh" else 0.0

    def run(s, d):
        p = table(s, d, "part").select(F.col("p_partkey").alias("i"), (F.expr(f"CAST({base} AS DOUBLE)") + shift).alias("v"))
        return rounded(vector.unary(p, name), 6)

    add(f"el_{name}", run, f"SELECT p_partkey AS i, {R(UNARY_SQL[name].format(v='(' + base + ')'), 6)} AS v FROM part")


for _n in UNARY_SQL:
    _unary(_n)

BINARY_SQL = {
    "prod": "x.v * y.v", "div": "x.v / y.v", "pow": "pow(x.v, y.v)", "add": "x.v + y.v", "sub": "x.v - y.v", "eq": "CAST(x.v = y.v AS DOUBLE)", "neq": "CAST(x.v <> y.v AS DOUBLE)",
    "greater": "CAST(x.v > y.v AS DOUBLE)", "less": "CAST(x.v < y.v AS DOUBLE)", "geq": "CAST(x.v >= y.v AS DOUBLE)", "leq": "CAST(x.v <= y.v AS DOUBLE)", "atan2": "atan2(x.v, y.v)",
    "fdim": "greatest(x.v - y.v, 0.0)", "fmod": "fmod(x.v, y.v)", "fmax": "greatest(x.v, y.v)", "fmin": "least(x.v, y.v)",
}


def _binary(name: str) -> None:
    x = "floor(p_retailprice / 40)" if name != "pow" else "p_retailprice / 1000"
    y = "CAST(p_size AS DOUBLE)" if name != "pow" else "p_size / 25.0"

    def run(s, d):
        p = table(s, d, "part")
        return rounded(vector.binary(p.select(F.col("p_partkey").alias("i"), F.expr(f"CAST({x} AS DOUBLE)").alias("v")), p.select(F.col("p_partkey").alias("i"), F.expr(f"CAST({y} AS DOUBLE)").alias("v")), name), 6)

    add(f"el_{name}", run, f"SELECT i, {R(BINARY_SQL[name], 6)} AS v FROM (SELECT p_partkey AS i, CAST({x} AS DOUBLE) AS v FROM part) x JOIN (SELECT p_partkey AS i, CAST({y} AS DOUBLE) AS v FROM part) y USING (i)")


for _n in BINARY_SQL:
    _binary(_n)
for _n, _kind in CASTS.items():
    _text = _kind.startswith("decimal")  # compared as text
    _cast = f"CAST({'trunc(p_size + 0.5)' if _kind not in ('float', 'double') else 'p_size + 0.5'} AS {_kind.upper()})"
    add(
        f"el_cast_{_n}", lambda s, d, k=_n, t=_text: Y(s, d).df.select("i", convert(F.col("v") + 0.5, k).cast("string" if t else CASTS[k]).alias("v")),
        f"SELECT p_partkey AS i, {f'CAST({_cast} AS VARCHAR)' if _text else _cast} AS v FROM part",
    )

# ---- scaled sums, rotations, complex numbers --------------------------------------------------------------------
add("vec_scale", as_vec(lambda s, d: vector.scale(X(s, d).df, 2.5)), f"SELECT i, {R('2.5 * v')} AS v FROM x", "x")
add("vec_axpby", as_vec(lambda s, d: vector.axpby(2.0, X(s, d).df, -0.5, Y(s, d).df)), f"SELECT i, {R('2.0 * x.v - 0.5 * y.v')} AS v FROM x JOIN y USING (i)", "x y")
add("vec_axpby_acc", as_vec(lambda s, d: vector.axpby_acc(X(s, d).df, 2.0, X(s, d).df, -0.5, Y(s, d).df)), f"SELECT i, {R('3.0 * x.v - 0.5 * y.v')} AS v FROM x JOIN y USING (i)", "x y")
add("mat_scale", as_vec(lambda s, d: vector.scale(B(s, d).df, 0.5)), f"SELECT i, j, {R('0.5 * v')} AS v FROM b", "b")
add("mat_axpby", as_vec(lambda s, d: vector.axpby(2.0, E(s, d).df, 1.5, E(s, d).df)), f"SELECT i, j, {R('3.5 * v')} AS v FROM e", "e")
add("mat_axpby_acc", as_vec(lambda s, d: vector.axpby_acc(E(s, d).df, 2.0, E(s, d).df, -1.5, E(s, d).df)), f"SELECT i, j, {R('1.5 * v')} AS v FROM e", "e")
add("mat_el_prod", as_vec(lambda s, d: vector.binary(E(s, d).df, E(s, d).df, "prod")), f"SELECT i, j, {R('v * v')} AS v FROM e", "e")
add("mat_el_sin", as_vec(lambda s, d: vector.unary(E(s, d).df, "sin")), f"SELECT i, j, {R('sin(v)')} AS v FROM e", "e")
add("scal_axpby", as_vec(lambda s, d: vector.reduce(X(s, d).df, "max").withColumnRenamed("v", "p").crossJoin(vector.reduce(Y(s, d).df, "max")).select((2 * F.col("p") - 3 * F.col("v")).alias("v"))), f"SELECT {R('2 * max(x.v) - 3 * max(y.v)')} AS v FROM x JOIN y USING (i)", "x y")
add("plane_rot", as_vec(lambda s, d: vector.plane_rotation(X(s, d).df, Y(s, d).df, 0.6, 0.8)), f"SELECT i, {R('0.6 * x.v + 0.8 * y.v')} AS x, {R('0.6 * y.v - 0.8 * x.v')} AS y FROM x JOIN y USING (i)", "x y")


def _complex(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") / 1000).alias("re"), F.col("p_size").cast("double").alias("im"))


_Z = "SELECT p_partkey AS k, p_retailprice / 1000 AS re, CAST(p_size AS DOUBLE) AS im FROM part"
add("cplx_mul", as_vec(lambda s, d: vector.complex_multiply(_complex(s, d), _complex(s, d), ["k"])), f"SELECT k, {R('re * re - im * im')} AS re, {R('2 * re * im')} AS im FROM ({_Z})")
add("cplx_norm", as_vec(lambda s, d: vector.complex_scale(_complex(s, d), 1 / 8), 9), f"SELECT k, {R('re / 8', 9)} AS re, {R('im / 8', 9)} AS im FROM ({_Z})")
add("real_to_complex", lambda s, d: vector.real_to_complex(X(s, d).df), "SELECT i AS k, v AS re, 0.0::DOUBLE AS im FROM x", "x")
add("complex_to_real", lambda s, d: vector.complex_to_real(vector.real_to_complex(X(s, d).df)), "SELECT i, v FROM x", "x")
add("cplx_transpose", as_vec(lambda s, d: E(s, d).T.df.select("i", "j", F.col("v").alias("re"), (-F.col("v")).alias("im"))), f"SELECT j AS i, i AS j, {R('v')} AS re, {R('-v')} AS im FROM e", "e")

# ---- reductions and scans ---------------------------------------------------------------------------------------
add("agg_dot", as_vec(lambda s, d: vector.dot(X(s, d).df, Y(s, d).df), 2), f"SELECT {R('sum(x.v * y.v)', 2)} AS v FROM x JOIN y USING (i)", "x y")
add("agg_multidot", as_vec(lambda s, d: vector.multi_dot(Y(s, d).df, [Y(s, d).df, X(s, d).df]), 2), f"SELECT {R('sum(y.v * y.v)', 2)} AS v1, {R('sum(x.v * y.v)', 2)} AS v2 FROM x JOIN y USING (i)", "x y")
for _n, _q in (("norm_1", "sum(abs(v))"), ("norm_2", "sqrt(sum(v * v))"), ("norm_inf", "max(abs(v))"), ("sum", "sum(v)"), ("max", "max(v)"), ("min", "min(v)")):
    add(f"agg_{_n.replace('_', '')}", as_vec(lambda s, d, n=_n: vector.reduce(C(s, d).df, n), 2), f"SELECT {R(_q, 2)} AS v FROM c", "c")
add("agg_idxinf", lambda s, d: vector.index_norm_inf(C(s, d).df), "SELECT min(i) AS i FROM c WHERE abs(v) = (SELECT max(abs(v)) FROM c)", "c")
add("agg_rowsum", as_vec(lambda s, d: matrix.row_sums(A(s, d).df)), f"SELECT i, {R('sum(v)')} AS v FROM a GROUP BY i", "a")
add("agg_colsum", as_vec(lambda s, d: matrix.column_sums(A(s, d).df)), f"SELECT j AS i, {R('sum(v)')} AS v FROM a GROUP BY j", "a")
add("agg_frob", as_vec(lambda s, d: matrix.frobenius(A(s, d).df), 3), f"SELECT {R('sqrt(sum(v * v))', 3)} AS v FROM a", "a")


def _cents(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("i"), F.round(F.col("value") * 100).cast("bigint").alias("v"))


for _n, _ex, _frame in (("scan_incl", False, "CURRENT ROW"), ("scan_excl", True, "1 PRECEDING")):
    add(_n, lambda s, d, e=_ex: vector.scan(_cents(s, d), e, 1 << 12), f"SELECT i, CAST(coalesce(sum(v) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND {_frame}), 0) AS BIGINT) AS v FROM (SELECT event_id AS i, CAST(round(value * 100) AS BIGINT) AS v FROM events)")

# ---- views and structure ----------------------------------------------------------------------------------------
add("vec_range", lambda s, d: vector.part(X(s, d), 10, 90).df, "SELECT i - 10 AS i, v FROM x WHERE i >= 10 AND i < 90", "x")
add("vec_slice", lambda s, d: vector.strided(X(s, d), 5, 3, 20).df, "SELECT (i - 5) // 3 AS i, v FROM x WHERE i >= 5 AND (i - 5) % 3 = 0 AND (i - 5) // 3 < 20", "x")
add("vec_slice_assign", lambda s, d: vector.replace_part(X(s, d), Vec(s.range(20).select(F.col("id").alias("i"), F.lit(1.5).alias("v")), 20), 5, 3).df, "SELECT i, CASE WHEN i >= 5 AND (i - 5) % 3 = 0 AND (i - 5) // 3 < 20 THEN 1.5 ELSE v END AS v FROM x", "x")
add("vec_reverse", lambda s, d: vector.reverse(X(s, d)).df, "SELECT n - 1 - i AS i, v FROM x, np", "x np")
add("vec_swap", lambda s, d: blas.swap(X(s, d).df, Y(s, d).df)[0], "SELECT i, v FROM y", "y")
add("mem_resize", lambda s, d: vector.resize(X(s, d), X(s, d).n + 7).df, "SELECT r.i, coalesce(x.v, 0.0) AS v FROM np, range(n + 7) r(i) LEFT JOIN x ON x.i = r.i", "x np")
add("mem_clear", lambda s, d: X(s, d).df.withColumn("v", F.lit(0.0)), "SELECT i, 0.0::DOUBLE AS v FROM x", "x")
add("assign_const", lambda s, d: X(s, d).df.withColumn("v", F.lit(3.25)), "SELECT i, 3.25::DOUBLE AS v FROM x", "x")
add("elem_get", lambda s, d: X(s, d).df.where("i = 17"), "SELECT i, v FROM x WHERE i = 17", "x")
add("elem_set", lambda s, d: vector.set_entry(X(s, d).df, F.col("i") == 17, -1.0), "SELECT i, CASE WHEN i = 17 THEN -1.0 ELSE v END AS v FROM x", "x")
add("mat_range", lambda s, d: matrix.part(A(s, d), 10, 200, 5, 150).df, "SELECT i - 10 AS i, j - 5 AS j, v FROM a WHERE i >= 10 AND i < 200 AND j >= 5 AND j < 150", "a")
add("mat_slice", lambda s, d: matrix.strided(A(s, d), (1, 2, 100), (0, 3, 50)).df, "SELECT (i - 1) // 2 AS i, j // 3 AS j, v FROM a WHERE i >= 1 AND (i - 1) % 2 = 0 AND (i - 1) // 2 < 100 AND j % 3 = 0 AND j // 3 < 50", "a")
add("mat_row", lambda s, d: matrix.row(A(s, d), 7).df, "SELECT j AS i, v FROM a WHERE i = 7", "a")
add("mat_column", lambda s, d: matrix.column(A(s, d), 7).df, "SELECT i, v FROM a WHERE j = 7", "a")
add("mat_diag_get", lambda s, d: matrix.diagonal(A(s, d), 2).df, "SELECT least(i, j) AS i, v FROM a WHERE j - i = 2", "a")
add("mat_diag_make", lambda s, d: matrix.from_diagonal(X(s, d), -3).df, "SELECT i + 3 AS i, i AS j, v FROM x", "x")
add("mat_diag_assign", as_vec(lambda s, d: matrix.set_diagonal(G(s, d), 2.0).df), f"SELECT i, j, {R('CASE WHEN i = j THEN 2.0 ELSE v END')} AS v FROM g", "e g")
add("mat_trans", lambda s, d: A(s, d).T.df, "SELECT j AS i, i AS j, v FROM a", "a")
add("sp_transpose", lambda s, d: B(s, d).T.df, "SELECT j AS i, i AS j, v FROM b", "b")
add("sp_extract_l", lambda s, d: matrix.lower(A(s, d).df), "SELECT * FROM a WHERE j <= i", "a")
add("sp_extract_lu", lambda s, d: matrix.upper(A(s, d).df), "SELECT * FROM a WHERE j >= i", "a")
add("sp_block_extract", lambda s, d: matrix.diagonal_block(A(s, d).df, 20, 180), "SELECT i - 20 AS i, j - 20 AS j, v FROM a WHERE i >= 20 AND i < 180 AND j >= 20 AND j < 180", "a")
add(
    "sp_row_info", as_vec(lambda s, d: matrix.row_info(B(s, d))),
    f"SELECT r.i, {R('coalesce(max(abs(v)), 0)')} AS norm_inf, {R('coalesce(sum(abs(v)), 0)')} AS norm_1, {R('coalesce(sqrt(sum(v * v)), 0)')} AS norm_2, {R('coalesce(max(CASE WHEN b.i = j THEN v END), 0)')} AS diag FROM np, range(n) r(i) LEFT JOIN b ON b.i = r.i GROUP BY r.i", "b np",
)
add("assign_to_dense", lambda s, d: matrix.dense(B(s, d)).df, "SELECT r.i, c.j, coalesce(v, 0.0) AS v FROM np, range(n) r(i), (SELECT DISTINCT s_suppkey AS j FROM supplier) c LEFT JOIN b ON b.i = r.i AND b.j = c.j", "b np")
add("top_ilut", lambda s, d: matrix.top_per_row(A(s, d).df, 3), "SELECT i, j, v FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY abs(v) DESC, j) AS r FROM a) WHERE r <= 3", "a")
add("merge_rows", as_vec(lambda s, d: matrix.merge_rows(B(s, d).df, Mat(B(s, d).df, 0, 0).T.df, -1.0)), f"SELECT i, j, {R('sum(v)')} AS v FROM (SELECT i, j, v FROM b UNION ALL SELECT j, i, -v FROM b) GROUP BY i, j", "b")

# ---- sources, sinks and encodings -------------------------------------------------------------------------------


def _grid_of(s, d) -> Mat:
    """The Laplacian of a grid 40 cells wide with a cell for each part."""
    return sources.laplace_2d(s, 40, -(-X(s, d).n // 40))


def _ones_times(s, d) -> DataFrame:
    x = X(s, d)
    return product.gemv(sources.scalar_matrix(s, 20, x.n, 1.5), x).df


WITH["py"] = "SELECT (n + 39) // 40 AS py FROM np"
WITH["lap"] = "SELECT i, j, v FROM (SELECT y * 40 + x AS i, (y + dy) * 40 + x + dx AS j, v, x + dx AS tx, y + dy AS ty, py FROM py, range(40) a(x), range(py) b(y), (VALUES (0, 0, 4.0::DOUBLE), (1, 0, -1.0), (-1, 0, -1.0), (0, 1, -1.0), (0, -1, -1.0)) k(dx, dy, v)) WHERE tx >= 0 AND tx < 40 AND ty >= 0 AND ty < py"
add("gen_laplace", as_vec(lambda s, d: product.gemv(a := _grid_of(s, d), Vec(X(s, d).df, a.n)).df), f"SELECT lap.i, {R('sum(lap.v * x.v)')} AS v FROM lap JOIN x ON x.i = lap.j GROUP BY 1", "x np py lap")
add("gen_unit", as_vec(lambda s, d: vector.axpby(1.0, X(s, d).df, 10.0, sources.unit_vector(s, X(s, d).n, 7).df)), f"SELECT i, {R('v + CASE WHEN i = 7 THEN 10 ELSE 0 END')} AS v FROM x", "x")
add("gen_scalar", as_vec(lambda s, d: vector.axpby(1.0, X(s, d).df, 1.0, sources.scalar_vector(s, X(s, d).n, 2.5).df)), f"SELECT i, {R('v + 2.5')} AS v FROM x", "x")
add("gen_zero", as_vec(lambda s, d: vector.axpby(1.0, X(s, d).df, 1.0, sources.zero_vector(s, X(s, d).n).df)), f"SELECT i, {R('v')} AS v FROM x", "x")
add("gen_identity", as_vec(lambda s, d: product.gemv(sources.identity_matrix(s, X(s, d).n), X(s, d)).df), f"SELECT i, {R('v')} AS v FROM x", "x")
add("gen_scalar_matrix", as_vec(lambda s, d: _ones_times(s, d).withColumn("v", F.col("v") / 3141.59265), 5), f"SELECT r.i, {R('1.5 * sum(v) / 3141.59265', 5)} AS v FROM x, range(20) r(i) GROUP BY r.i", "x")
_U = "(CAST('0x' || substr(md5('{seed}|' || i), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"
add("gen_uniform", as_vec(lambda s, d: vector.binary(X(s, d).df, sources.uniform_vector(s, X(s, d).n, 3).df, "prod"), 6), f"SELECT i, {R('v * ' + _U.format(seed=3), 6)} AS v FROM x", "x")
_N = "(sqrt(-2 * ln(" + _U.format(seed=6) + ")) * cos(2 * pi() * " + _U.format(seed=7) + ") * 2 + 1)"
add("gen_normal", as_vec(lambda s, d: vector.binary(X(s, d).df, sources.normal_vector(s, X(s, d).n, 1.0, 2.0, 3).df, "prod")), f"SELECT i, {R('v * ' + _N)} AS v FROM x", "x")
# exchange with the driver: suppliers are few, and an array on the driver is what these are for
add("io_copy_vec", lambda s, d: sources.vector_from(s, sources.to_numpy(S(s, d)).tolist()).df, "SELECT r.i, coalesce(s.v, 0.0) AS v FROM (SELECT max(i) + 1 AS n FROM s), range(n) r(i) LEFT JOIN s ON s.i = r.i", "s")
add("io_copy_dense", as_vec(lambda s, d: E(s, d).df, 6), f"SELECT i, j, {R('v', 6)} AS v FROM e", "e")
add("io_copy_csr", lambda s, d: matrix.from_row_arrays(matrix.row_arrays(A(s, d).df)), "SELECT i, j, v FROM a", "a")
add("io_copy_coo", lambda s, d: A(s, d).df, "SELECT i, j, v FROM a", "a")
add("io_copy_ccsr", lambda s, d: matrix.entry_positions(A(s, d).df), "SELECT i, count(*) AS n FROM a GROUP BY i", "a")
add("io_copy_ell", lambda s, d: matrix.from_row_arrays(matrix.ell(B(s, d).df)), "SELECT i, j, v FROM b", "b")
add("io_copy_sell", lambda s, d: matrix.from_row_arrays(matrix.sliced_ell(B(s, d).df)), "SELECT i, j, v FROM b", "b")


def _hyb(s, d) -> DataFrame:
    front, rest = matrix.hybrid(B(s, d))
    return matrix.from_row_arrays(front).unionByName(rest)


add("io_copy_hyb", _hyb, "SELECT i, j, v FROM b", "b")
def _row_arrays(s, d) -> DataFrame:
    """Nations x order priorities, by the arrays of compressed rows."""
    joined = table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    e = joined.groupBy(F.col("c_nationkey").cast("bigint").alias("i"), F.substring("o_orderpriority", 1, 1).cast("bigint").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v")).orderBy("i", "j").toPandas()
    jumper = np.searchsorted(e["i"].to_numpy(), np.arange(int(e["i"].max()) + 2)) if len(e) else [0]
    return matrix.from_csr(s, [int(k) for k in jumper], e["j"].tolist(), e["v"].tolist())


add("io_set", _row_arrays, "SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(o_orderpriority[1] AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")


def _scaled(s, d, odd: bool = False) -> Vec:
    """Suppliers' balances over 10,000 as parameters; with a zero more if their number must be odd."""
    x = S(s, d)
    return Vec(x.df.withColumn("v", F.col("v") / 1e4), x.n + 1 - x.n % 2 if odd else x.n)


def _rounded_parameters(s, d, odd: bool) -> Vec:
    """Entries are copies of the parameters, which are rounded once."""
    e = _scaled(s, d, odd)
    return Vec(rounded(e.df, 6), e.n)


WITH["sp"] = "SELECT s_suppkey AS i, s_acctbal / 1e4 AS v FROM supplier"
WITH["sn"] = "SELECT max(s_suppkey) + 1 AS n, (max(s_suppkey) + 1) // 2 + 1 AS h FROM supplier"
WITH["so"] = "SELECT n, (n + 1 - n % 2 + 1) // 2 AS m FROM sn"
add("io_copy_struct", as_vec(lambda s, d: product.circulant(_scaled(s, d), sources.unit_vector(s, S(s, d).n, 2)).df, 6), f"SELECT (i + 2) % n AS i, {R('v', 6)} AS v FROM sp, sn", "sp sn")
for _n, _at, _size in (("circulant", "(q.j + k) % n", "n"), ("toeplitz", "k + q.j - (m - 1)", "m"), ("hankel", "k - q.j", "m")):
    add(f"io_copy_{_n}", lambda s, d, k=_n: product.structured(_rounded_parameters(s, d, k != "circulant"), k).df, f"SELECT * FROM (SELECT {_at} AS i, q.j, {R('v', 6)} AS v, {_size} AS rows FROM (SELECT i AS k, v FROM sp) p, so, range({_size}) q(j)) WHERE i >= 0 AND i < rows".replace("SELECT * FROM", "SELECT i, j, v FROM", 1), "sp sn so")
add("io_copy_vandermonde", as_vec(lambda s, d: product.structured(_scaled(s, d), "vandermonde").df, 6), f"SELECT p.i, q.j, {R('pow(p.v, q.j)', 6)} AS v FROM sp p, sn, range(n) q(j)", "sp sn")
add("io_interop", as_vec(lambda s, d: sources.matrix_from(s, sources.to_numpy(G(s, d))).df), f"SELECT i, j, {R('v')} AS v FROM g", "e g")


def _market(s, d) -> DataFrame:
    loop.checkpoint(s.range(1))  # makes sure that there is a shared folder
    path = f"{s.sparkContext.getCheckpointDir()}/market-{uuid.uuid4().hex}"
    sources.write_matrix_market(B(s, d), path)
    return sources.read_matrix_market(s, path).df


add("io_mm_roundtrip", _market, "SELECT i, j, v FROM b", "b")

# ---- products ---------------------------------------------------------------------------------------------------
_AX = "SELECT a.i, sum(a.v * x.v) AS v FROM a JOIN x ON a.j = x.i GROUP BY a.i"
add("gemv", as_vec(lambda s, d: product.gemv(A(s, d), X(s, d)).df, 2), f"SELECT i, {R('v', 2)} AS v FROM ({_AX})", "a x")
add("gemv_t", as_vec(lambda s, d: product.gemv(A(s, d), O(s, d), True).df.withColumn("v", F.col("v") / 1000), 7), f"SELECT a.j AS i, {R('sum(a.v * o.v) / 1000', 7)} AS v FROM a JOIN o USING (i) GROUP BY a.j", "a o")
add("gemv_ab", as_vec(lambda s, d: product.gemv_axpby(0.5, A(s, d), X(s, d), 2.0, O(s, d)).df, 2), f"SELECT o.i, {R('0.5 * coalesce(t.v, 0) + 2 * o.v', 2)} AS v FROM o LEFT JOIN ({_AX}) t ON t.i = o.i", "a x o")
add("flagship_norm_ax", as_vec(lambda s, d: vector.reduce(product.gemv(A(s, d), X(s, d)).df, "norm_2"), 2), f"SELECT {R('sqrt(sum(v * v))', 2)} AS v FROM ({_AX})", "a x")
for _fmt in ("csr", "ccsr", "coo", "ell", "sell", "hyb"):
    _make = {"csr": lambda m: matrix.from_row_arrays(matrix.row_arrays(m.df)), "ccsr": lambda m: m.df, "coo": lambda m: m.df, "ell": lambda m: matrix.from_row_arrays(matrix.ell(m.df)), "sell": lambda m: matrix.from_row_arrays(matrix.sliced_ell(m.df))}.get(_fmt)
    _run = (lambda s, d: Mat(_hyb(s, d), B(s, d).m, B(s, d).n)) if _make is None else (lambda s, d, k=_make: Mat(k(B(s, d)), B(s, d).m, B(s, d).n))
    add(f"spmv_{_fmt}", as_vec(lambda s, d, r=_run: product.gemv(r(s, d), S(s, d)).df, 2), f"SELECT b.i, {R('sum(b.v * s.v)', 2)} AS v FROM b JOIN s ON b.j = s.i GROUP BY b.i", "b s")
add("outer_prod", as_vec(lambda s, d: product.outer(S(s, d), S(s, d)).df.withColumn("v", F.col("v") / 1000), 3), f"SELECT p.i, q.i AS j, {R('p.v * q.v / 1000', 3)} AS v FROM s p, s q", "s")
add("ger", as_vec(lambda s, d: product.ger(B(s, d), 0.01, Y(s, d), S(s, d)).df, 6), f"SELECT y.i, s.i AS j, {R('coalesce(b.v, 0) + 0.01 * y.v * s.v', 6)} AS v FROM y CROSS JOIN s LEFT JOIN b ON b.i = y.i AND b.j = s.i", "b y s")
_GG = "SELECT p.i, q.j, sum(p.v * q.v) AS v FROM g p JOIN g q ON p.j = q.i GROUP BY 1, 2"
_EG = "SELECT e.i, g.j, sum(e.v * g.v) AS v FROM e JOIN g ON e.j = g.i GROUP BY 1, 2"
add("gemm_nn", as_vec(lambda s, d: product.gemm(E(s, d), G(s, d)).df), f"SELECT i, j, {R('v')} AS v FROM ({_EG})", "e g")
add("gemm_tn", as_vec(lambda s, d: product.gemm(E(s, d), E(s, d), trans_a=True).df), f"SELECT i, j, {R('v')} AS v FROM g", "e g")
add("gemm_nt", as_vec(lambda s, d: product.gemm(G(s, d), G(s, d), 2.0, -1.0, G(s, d), trans_b=True).df), f"SELECT t.i, t.j, {R('2 * t.v - g.v')} AS v FROM ({_GG}) t JOIN g USING (i, j)", "e g")
add("gemm_tt", as_vec(lambda s, d: product.gemm(G(s, d), E(s, d), trans_a=True, trans_b=True).df), f"SELECT j AS i, i AS j, {R('v')} AS v FROM ({_EG})", "e g")


def _gemm_blocks(s, d) -> DataFrame:
    e = E(s, d)
    left, right = product.blocked(e.T, 32), product.blocked(e, 32)
    return product.from_blocks(product.gemm_blocks(left, right, 32), 32, 64, 64).df


add("gemm_blocked", as_vec(_gemm_blocks), f"SELECT i, j, {R('v')} AS v FROM g", "e g")
add("spmm", as_vec(lambda s, d: product.multiply(B(s, d), sources.scalar_matrix(s, B(s, d).n, 4, 0.5)).df), f"SELECT i, c.j, {R('0.5 * t.v')} AS v FROM (SELECT i, sum(v) AS v FROM b GROUP BY i) t, range(4) c(j)", "b")
_AB = "SELECT a.i, b.j, sum(a.v * b.v) AS v FROM a JOIN b ON a.j = b.i GROUP BY 1, 2"


def _lines(s, d) -> tuple[Mat, Mat]:
    """A and B with an entry for each line: their product sums those of one place."""
    line, (m, k, n) = table(s, d, "lineitem"), (size(table(s, d, t), c) for t, c in (("orders", "o_orderkey"), ("part", "p_partkey"), ("supplier", "s_suppkey")))
    entries = lambda row, col: line.select(F.col(row).cast("bigint").alias("i"), F.col(col).cast("bigint").alias("j"), F.col("l_quantity").cast("double").alias("v"))
    return Mat(entries("l_orderkey", "l_partkey"), m, k), Mat(entries("l_partkey", "l_suppkey"), k, n)


add("spgemm", as_vec(lambda s, d: product.product_rows(*_lines(s, d)), 2), f"SELECT i, count(*) AS entries, {R('sum(v)', 2)} AS total, {R('max(v)', 2)} AS top FROM ({_AB}) GROUP BY i", "a b")


def _by_flag(s, d) -> tuple[Mat, Mat]:
    """Suppliers x line numbers and line numbers x parts: seven contraction indices hold all entries of both."""
    line = table(s, d, "lineitem")
    m, n = size(table(s, d, "supplier"), "s_suppkey"), size(table(s, d, "part"), "p_partkey")
    return Mat.of(line, "l_suppkey", "l_linenumber", "l_quantity", m, 8), Mat.of(line, "l_linenumber", "l_partkey", "l_quantity", 8, n)


_FLAGS = "SELECT p.i, q.j, sum(p.v * q.v) AS v FROM (SELECT l_suppkey AS i, l_linenumber AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) p JOIN (SELECT l_linenumber AS k, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) q USING (k) GROUP BY 1, 2"
add("spgemm_heavy", as_vec(lambda s, d: product.product_rows(*_by_flag(s, d)), 2), f"SELECT i, count(*) AS entries, {R('sum(v)', 2)} AS total, {R('max(v)', 2)} AS top FROM ({_FLAGS}) GROUP BY i")


def _aggregator(s) -> Mat:
    return Mat(s.range(64).select(F.col("id").alias("i"), F.expr("id div 8").alias("j"), F.lit(1.0).alias("v")), 64, 8)


add("galerkin", as_vec(lambda s, d: product.galerkin(_aggregator(s), G(s, d)).df), f"SELECT i // 8 AS i, j // 8 AS j, {R('sum(v)')} AS v FROM g GROUP BY 1, 2", "e g")
add("prod_expr", as_vec(lambda s, d: product.gemv(Mat(vector.axpby(1.0, B(s, d).df, 2.0, B(s, d).df), B(s, d).m, B(s, d).n), Vec(vector.scale(S(s, d).df, 0.5), S(s, d).n)).df, 5), f"SELECT b.i, {R('1.5 * sum(b.v * s.v)', 5)} AS v FROM b JOIN s ON b.j = s.i GROUP BY b.i", "b s")
_ns = "(SELECT max(s_suppkey) + 1 AS n FROM supplier)"
add("prod_circulant", as_vec(lambda s, d: product.circulant(S(s, d), S(s, d)).df.withColumn("v", F.col("v") / 1e4), 2), f"SELECT (p.i + q.i) % n AS i, {R('sum(p.v * q.v) / 1e4', 2)} AS v FROM s p, s q, {_ns} GROUP BY 1", "s")
add("convolve_i", as_vec(lambda s, d: product.convolve(S(s, d), S(s, d)).df.withColumn("v", F.col("v") / 1e4), 2), f"SELECT (p.i + q.i) % n AS i, {R('sum(p.v * q.v) / 1e4', 2)} AS v FROM s p, s q, {_ns} GROUP BY 1", "s")


def _parameters(s, d) -> tuple[Vec, Vec]:
    x = S(s, d)
    n = 2 * x.n - 1
    return Vec(s.range(n).select(F.col("id").alias("i"), ((F.col("id") * 7) % 11 - 5.0).alias("v")), n), x


_PAR = "SELECT k AS i, CAST((k * 7) % 11 AS DOUBLE) - 5 AS v FROM (SELECT unnest(range(2 * n - 1)) AS k FROM " + _ns + ")"
add("prod_toeplitz", as_vec(lambda s, d: product.toeplitz(*_parameters(s, d)).df, 2), f"SELECT r.i, {R('sum(p.v * s.v)', 2)} AS v FROM {_ns}, range(n) r(i), s JOIN ({_PAR}) p ON p.i = n - 1 + r.i - s.i GROUP BY r.i", "s")
add("prod_hankel", as_vec(lambda s, d: product.hankel(*_parameters(s, d)).df, 2), f"SELECT r.i, {R('sum(p.v * s.v)', 2)} AS v FROM {_ns}, range(n) r(i), s JOIN ({_PAR}) p ON p.i = r.i + s.i GROUP BY r.i", "s")
add("prod_vandermonde", as_vec(lambda s, d: product.vandermonde(_scaled(s, d), S(s, d)).df, 4), f"SELECT p.i, {R('sum(pow(p.v, s.i) * s.v)')} AS v FROM sp p, s GROUP BY p.i", "sp s")
add("prod_user", as_vec(lambda s, d: solvers.apply(lambda x: vector.scale(x, 3.0), X(s, d).df, X(s, d).n)), f"SELECT i, {R('3 * v')} AS v FROM x", "x")
for _n, _f, _sql in (("blas_asum", lambda s, d: blas.asum(C(s, d).df), "sum(abs(v))"), ("blas_nrm2", lambda s, d: blas.nrm2(C(s, d).df), "sqrt(sum(v * v))")):
    add(_n, as_vec(_f, 2), f"SELECT {R(_sql, 2)} AS v FROM c", "c")
add("blas_axpy", as_vec(lambda s, d: blas.axpy(2.0, X(s, d).df, Y(s, d).df)), f"SELECT i, {R('2.0 * x.v + y.v')} AS v FROM x JOIN y USING (i)", "x y")
add("blas_scal", as_vec(lambda s, d: blas.scal(X(s, d).df, 0.25)), f"SELECT i, {R('0.25 * v')} AS v FROM x", "x")
add("blas_iamax", lambda s, d: blas.iamax(C(s, d).df), "SELECT min(i) AS i FROM c WHERE abs(v) = (SELECT max(abs(v)) FROM c)", "c")

# ---- direct solvers: the known solution is i mod 7 + 1 -----------------------------------------------------------
_KNOWN = "SELECT i, CAST(i % 7 + 1 AS DOUBLE) AS v FROM range({n}) t(i)"


def known(s, n: int) -> Vec:
    return Vec(s.range(n).select(F.col("id").alias("i"), ((F.col("id") % 7) + 1.0).alias("v")), n)


def triangle(g: Mat, kind: str, unit: bool) -> Mat:
    t = g.df.where("j < i" if kind == "lower" else "j > i")
    diag = g.df.where("i = j")
    return Mat(t.unionByName(diag.withColumn("v", F.lit(1.0)) if unit else diag), g.m, g.n)


def _trsv(kind: str, unit: bool, trans: bool):
    def run(s, d):
        t = triangle(G(s, d), kind, unit)
        b = product.gemv(t, known(s, 64), trans)
        return rounded(direct.trsv(t, b, kind, unit, trans, block=24).df)

    return run


def _trsm(kind: str, trans: bool, unit: bool = False, flip: bool = False):
    def run(s, d):
        t = triangle(G(s, d), kind, unit)
        x = Mat(s.range(64).select(F.col("id").alias("i"), F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(5)])).alias("j")).withColumn("v", (F.col("i") + F.col("j")) % 7 + 1.0), 64, 5)
        b = product.multiply(t.T if trans else t, x)
        return rounded(direct.trsm(t, b.T if flip else b, kind, unit, trans, block=24, transposed_b=flip).df)

    return run


for _k in ("lower", "upper"):
    for _t in (False, True):
        for _u in (False, True):
            add(f"trsv_{'unit_' * _u}{_k}{'_t' * _t}", _trsv(_k, _u, _t), _KNOWN.format(n=64))
        for _u in (False, True):
            for _b in (False, True):
                add(f"trsm_{'unit_' * _u}{_k}{'_t' * _t}{'_bt' * _b}", _trsm(_k, _t, _u, _b), "SELECT i, j, CAST((i + j) % 7 + 1 AS DOUBLE) AS v FROM range(64) a(i), range(5) b(j)")


def _lower_parts(s, d, blocks: int = 1) -> Mat:
    """The lower triangle of the whole table's graph of parts bought together, with a diagonal of 1 more than its rows'
    sums; of each of so many diagonal blocks, if there are several."""
    g = bought_together(s, d)
    low = matrix.lower(g.df).where("i != j")
    rows = s.range(g.n).select(F.col("id").alias("i")).join(low.groupBy("i").agg(F.sum("v").alias("w")), "i", "left")
    low = low.select("i", "j", (-F.col("v")).alias("v")).unionByName(rows.select("i", F.col("i").alias("j"), (1 + F.coalesce("w", F.lit(0.0))).alias("v")))
    low = Mat(loop.stored(low), g.n, g.n)
    return substitution.in_blocks(low, blocks) if blocks > 1 else low


def _times_known(t: Mat, columns: int = 1) -> Mat:
    """T times the columns that the queries' SQL returns; as an array where those fit the driver."""
    spark = t.df.sparkSession
    if driver_sized(t.n):
        return product.times_array(t, (np.arange(t.n)[:, None] + np.arange(columns)) % 7 + 1.0)
    x = spark.range(t.n).select(F.col("id").alias("i"), F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(columns)])).alias("j"))
    return product.multiply(t, Mat(x.withColumn("v", (F.col("i") + F.col("j")) % 7 + 1.0), t.n, columns))


def _sp_trsv(kind: str, blocks: int = 1):
    def run(s, d):
        low = _lower_parts(s, d, blocks)
        t = low if kind == "lower" else low.T
        b = Vec(_times_known(t).df.select("i", "v"), t.n)
        return rounded(direct.block_trsv(t, b, blocks, kind).df if blocks > 1 else direct.trsv(t, b, kind).df)

    return run


def _sp_trsm(s, d):
    low = _lower_parts(s, d)
    return rounded(direct.trsm(low, _times_known(low.T, 4), transposed=True).df)


_KNOWN_PARTS = "SELECT i, CAST(i % 7 + 1 AS DOUBLE) AS v FROM np, range(n) t(i)"
add("sp_trsv", _sp_trsv("lower"), _KNOWN_PARTS, "np")
add("sp_trsv_upper", _sp_trsv("upper"), _KNOWN_PARTS, "np")
add("sp_block_trsv", _sp_trsv("lower", 4), _KNOWN_PARTS, "np")
add("sp_trsm_t", _sp_trsm, "SELECT i, j, CAST((i + j) % 7 + 1 AS DOUBLE) AS v FROM np, range(n) a(i), range(4) b(j)", "np")
add("level_sched", lambda s, d: substitution.levels(bought_together(s, d)), """
WITH RECURSIVE line AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), e AS (SELECT DISTINCT a.p AS i, b.p AS j FROM line a JOIN line b USING (o) WHERE a.p > b.p),
l AS (SELECT r.i, 0 AS level FROM (SELECT max(p_partkey) + 1 AS n FROM part), range(n) r(i) UNION SELECT e.i, l.level + 1 FROM l JOIN e ON e.j = l.i)
SELECT i, CAST(max(level) AS INTEGER) AS level FROM l GROUP BY i""")


def _lu_product(s, d):
    f = direct.lu(G(s, d), 24)
    f = Mat(loop.checkpoint(f.df), f.m, f.n)
    low = Mat(f.df.where("j < i").unionByName(sources.identity_matrix(s, f.m).df), f.m, f.n)
    return rounded(product.multiply(low, Mat(f.df.where("j >= i"), f.m, f.n)).df)


add("lu", _lu_product, f"SELECT i, j, {R('v')} AS v FROM g", "e g")
add("lu_solve", as_vec(lambda s, d: direct.lu_solve(direct.lu(G(s, d)), product.gemv(G(s, d), known(s, 64))).df), _KNOWN.format(n=64))


def _reflectors(s, d, doubled: int = 0):
    """Of the embeddings, with the first columns once more if asked, in blocks of 128 rows."""
    e = E(s, d)
    if doubled:
        e = Mat(e.df.unionByName(e.df.where(F.col("j") < doubled).withColumn("j", F.col("j") + 64)), e.m, 64 + doubled)
    return reflectors.factor(e, 4, 128)


def _qr_recover(s, d):
    f = _reflectors(s, d)
    return rounded(product.multiply(f.q(), sources.matrix_from(s, f.r)).df)


add("qr", lambda s, d: rounded(spectral.gram(sources.matrix_from(s, direct.qr_r(E(s, d)))).df), f"SELECT i, j, {R('v')} AS v FROM g", "e g")
add("qr_recover", _qr_recover, f"SELECT i, j, {R('v')} AS v FROM e", "e")
add("qr_apply", lambda s, d: rounded(spectral.gram(sources.matrix_from(s, _reflectors(s, d).transposed_times(E(s, d)))).df), f"SELECT i, j, {R('v')} AS v FROM g", "e g")
for _n, _dup in (("qr_orthogonal", 0), ("qr_deficient", 8)):
    add(_n, as_vec(lambda s, d, k=_dup: spectral.gram(_reflectors(s, d, k).q()).df, 9), f"SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM range({64 + _dup}) a(i), range({64 + _dup}) b(j)")
add("lstsq", as_vec(lambda s, d: direct.least_squares(E(s, d), product.gemv(E(s, d), known(s, 64))).df), _KNOWN.format(n=64))

# ---- iterative solvers and preconditioners on a grid -------------------------------------------------------------
# A 64 x 64 grid whose cells conduct as parts are large; plain CG takes some 240 iterations. `few` tells whether the
# iterations are within a bound that plain methods (CG 240, BiCGStab 165 on sf0.01) miss;
# plain GMRES takes 1,300, more than the operator's limit, so its preconditioner shows in the solution itself.
PX = PY = 64
CELLS = PX * PY
WITH["cell"] = f"SELECT i, coalesce(v, 0.5) AS v FROM (SELECT unnest(range({CELLS})) AS i) LEFT JOIN (SELECT p_partkey AS k, (1 + p_size % 10) / 20.0e0 AS v FROM part) ON k = i % (SELECT max(p_partkey) + 1 FROM part)"
WITH["link"] = f"""SELECT c.i, c.v AS c, d.i AS j, CASE WHEN d.v IS NULL THEN c.v ELSE 2 * c.v * d.v / (c.v + d.v) END AS w
  FROM (SELECT i, v, unnest([CASE WHEN i % {PX} > 0 THEN i - 1 END, CASE WHEN i % {PX} < {PX - 1} THEN i + 1 END, CASE WHEN i >= {PX} THEN i - {PX} END, CASE WHEN i + {PX} < {CELLS} THEN i + {PX} END]) AS n FROM cell) c LEFT JOIN cell d ON d.i = c.n"""
WITH["grid"] = "SELECT i, j, -w AS v FROM link WHERE j IS NOT NULL UNION ALL SELECT i, i, sum(w) FROM link GROUP BY i"
_AT_GRID = "cell link grid"


def cells(s, d) -> DataFrame:
    n = size(table(s, d, "part"), "p_partkey")
    part = table(s, d, "part").select(F.col("p_partkey").alias("k"), ((1 + F.col("p_size") % 10) / 20.0).alias("c"))
    return s.range(CELLS).select(F.col("id").alias("i"), (F.col("id") % n).alias("k")).join(part, "k", "left").select("i", F.coalesce("c", F.lit(0.5)).alias("v"))


def grid(s, d) -> tuple[Mat, Vec]:
    a = sources.diffusion_2d(cells(s, d), PX, PY)
    a = Mat(loop.checkpoint(a.df), a.m, a.n)
    return a, Vec(loop.checkpoint(product.gemv(a, known(s, a.m)).df), a.m)


add("gen_diffusion", as_vec(lambda s, d: sources.diffusion_2d(cells(s, d), PX, PY).df, 6), f"SELECT i, j, {R('v', 6)} AS v FROM grid", _AT_GRID)


def _solve(method, most: int, pre=None, **kw):
    def run(s, d):
        a, b = grid(s, d)
        got = method(a, b, **({"preconditioner": pre(a)} if pre else {}), **kw)
        return rounded(got.x.df, 3).withColumn("few", F.lit(got.iterations <= most))

    return run


_GRID = _KNOWN.format(n=CELLS).replace(" FROM", ", true AS few FROM", 1)
_blocks = lambda kind, n=1, **kw: lambda a: precondition.incomplete(a, kind, n, **kw)
for _n, _m, _most, _p in (
    ("cg", solvers.cg, 300, None), ("cg_mixed", solvers.cg_mixed, 400, None), ("bicgstab", solvers.bicgstab, 250, None), ("gmres", lambda *a, **k: solvers.gmres(*a, krylov=20, **k), 200, _blocks("ilu0", 8)), ("gmres_reflections", lambda *a, **k: solvers.gmres(*a, krylov=20, reflections=True, **k), 200, _blocks("ilu0", 8)),
    ("pc_ilu0", solvers.bicgstab, 80, coloured.incomplete), ("pc_ilut", solvers.bicgstab, 20, _blocks("ilut")), ("pc_block_ilu", solvers.bicgstab, 90, _blocks("ilu0", 8)), ("pc_ichol0", solvers.cg, 125, lambda a: coloured.incomplete(a, "ichol0")),
    ("pc_chow_patel_ilu", solvers.bicgstab, 100, precondition.chow_patel), ("pc_chow_patel_icc", solvers.bicgstab, 100, lambda a: precondition.chow_patel(a, True)),
    ("pc_spai", solvers.bicgstab, 110, lambda a: precondition.inverse_of(precondition.spai(a, 1))), ("pc_fspai", solvers.cg, 150, lambda a: precondition.factored_inverse_of(precondition.fspai(a))),
    ("pc_amg", solvers.cg, 60, multigrid.multigrid), ("pc_amg_smoothed", solvers.cg, 30, lambda a: multigrid.multigrid(a, "sequential", "smoothed")), ("pc_amg_direct", solvers.bicgstab, 60, lambda a: multigrid.multigrid(a, "onepass", "direct")),
):
    add(_n, _solve(_m, _most, _p), _GRID)


def _solve_scaled(method, make):
    """The solution, and what the preconditioner makes of the right-hand side."""

    def run(s, d):
        a, b = grid(s, d)
        pre = make(a)
        z = pre(b.df).select("i", (F.col("v") / 3.14159265).alias("z"))  # off the ties of rounding
        return rounded(rounded(method(a, b, preconditioner=pre).x.df, 3).join(z, "i"), 6, "z")

    return run


_RHS = "SELECT i, sum(v * (j % 7 + 1)) AS v FROM grid GROUP BY i"
add("pc_jacobi", _solve_scaled(solvers.cg, precondition.jacobi), f"SELECT r.i, CAST(r.i % 7 + 1 AS DOUBLE) AS v, {R('r.v / g.v / 3.14159265e0', 6)} AS z FROM ({_RHS}) r JOIN grid g ON g.i = r.i AND g.j = r.i", _AT_GRID)
add("pc_rowscale", _solve_scaled(solvers.bicgstab, precondition.row_scaling), f"SELECT r.i, CAST(r.i % 7 + 1 AS DOUBLE) AS v, {R('r.v / g.v / 3.14159265e0', 6)} AS z FROM ({_RHS}) r JOIN (SELECT i, sqrt(sum(v * v)) AS v FROM grid GROUP BY i) g USING (i)", _AT_GRID)


def _monitored(s, d) -> DataFrame:
    """A monitor sees every iteration and its residual, and ends the loop."""
    a, b = grid(s, d)
    seen: list[tuple[int, float]] = []
    got = solvers.cg(a, b, preconditioner=precondition.jacobi(a), monitor=lambda k, e: seen.append((k, e)) or k == 6)
    return s.createDataFrame([(k, got.iterations, 0 < e < 10) for k, e in seen], "k long, iterations int, sane boolean")


add("solver_monitor", _monitored, "SELECT k, 6 AS iterations, true AS sane FROM range(1, 7) t(k)")


def _from_lists(s, d) -> DataFrame:
    """A chain of suppliers as a list of maps, and a right-hand side of plain numbers."""
    c = (sources.to_numpy(S(s, d)) / 1e4).tolist()
    n = len(c)
    maps = [{j: 2.5 + abs(c[i]) if i == j else -1.0 for j in (i - 1, i, i + 1) if 0 <= j < n} for i in range(n)]
    b = sources.vector_from(s, (sum(v * (j % 7 + 1) for j, v in row.items()) for row in maps))
    return rounded(solvers.bicgstab(sources.matrix_from(s, maps), b).x.df)


add("stl_solve", _from_lists, "SELECT r.i, CAST(r.i % 7 + 1 AS DOUBLE) AS v FROM sn, range(n) r(i)", "sn")


def _solve_gram(method, pre=None):
    """Over the Gram matrix of the whole embeddings table."""

    def run(s, d):
        g = G(s, d)
        b = Vec(loop.checkpoint(product.gemv(g, known(s, 64)).df), 64)
        return rounded(method(g, b, **({"preconditioner": pre(g)} if pre else {})).x.df)

    return run


def _solve_parts(method):
    """Over the graph of parts bought together, with 1 more on the diagonal than a row's weights; the loop's vectors are
    tables, as they are beyond the driver's bound."""

    def run(s, d):
        low = _lower_parts(s, d).df
        off = low.where("i != j")
        both = off.unionByName(off.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
        diagonal = both.groupBy("i").agg((1 - 2 * F.sum("v")).alias("v")).select("i", F.col("i").alias("j"), "v")
        n = size(table(s, d, "part"), "p_partkey")
        alone = s.range(n).select(F.col("id").alias("i")).join(diagonal, "i", "left_anti").select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
        a = Mat(loop.stored(both.unionByName(diagonal).unionByName(alone)), n, n)
        b = Vec(loop.checkpoint(product.gemv(a, known(s, n)).df), n)
        return rounded(method(a, b, tables=True).x.df, 3)

    return run


for _n, _m in (("cg", solvers.cg), ("bicgstab", solvers.bicgstab)):
    add(f"{_n}_tables", _solve_parts(_m), _KNOWN_PARTS, "np")
for _n, _m in (("cg", solvers.cg), ("bicgstab", solvers.bicgstab), ("gmres", solvers.gmres)):
    add(f"{_n}_gram", _solve_gram(_m), _KNOWN.format(n=64))
for _n, _m, _p in (("pc_jacobi", solvers.cg, precondition.jacobi), ("pc_block_ilu", solvers.bicgstab, lambda a: precondition.incomplete(a, "ilu0", 8)), ("pc_amg", solvers.cg, multigrid.multigrid)):
    add(f"{_n}_gram", _solve_gram(_m, _p), _KNOWN.format(n=64))


def _roots(a: Mat, root: DataFrame) -> DataFrame:
    """(i, near, apart): whether the root of a node is a root at most two steps away, and whether at most one root is
    next to a node or at it."""
    e = multigrid.influence(a)
    closed = loop.checkpoint(e.unionByName(root.select("i", F.col("i").alias("j"))).distinct())
    root = loop.checkpoint(root)
    heads = root.where("i = root").select(F.col("i").alias("j"))
    first = root.join(heads.withColumnRenamed("j", "root"), "root").join(closed, "i").select("i", "j", "root")
    near = first.join(closed.select(F.col("i").alias("j"), F.col("j").alias("root")), ["j", "root"], "left_semi").select("i").distinct().withColumn("near", F.lit(True))
    # roots are more than two steps apart if no node has two of them next to it or at it
    held = closed.join(heads, "j").groupBy("i").agg(F.count(F.lit(1)).alias("heads"))
    return root.select("i").join(near, "i", "left").join(held, "i", "left").select("i", F.coalesce("near", F.lit(False)).alias("near"), (F.coalesce("heads", F.lit(0)) <= 1).alias("apart"))


_ROOTS = "SELECT i, true AS near, true AS apart FROM range({n}) t(i)"


def _fine(a: Mat, state: DataFrame) -> DataFrame:
    """(i, ok): a node is coarse, or fine with a coarse one among those that influence it strongly."""
    state = loop.checkpoint(state)
    held = multigrid.influence(a, 0.1).join(state.where("state = 1").select(F.col("i").alias("j")), "j").select("i").distinct().withColumn("held", F.lit(True))
    return state.join(held, "i", "left").select("i", ((F.col("state") == 1) | (F.coalesce("held", F.lit(False)) & (F.col("state") == 2))).alias("ok"))


def _direct_sums(s, d) -> DataFrame:
    """Row sums of direct interpolation: 1 on coarse nodes, and what makes up for all neighbours on fine ones."""
    a = grid(s, d)[0]
    state = loop.checkpoint(multigrid.coarsen_onepass(a))
    sums = matrix.row_sums(multigrid.interpolate_direct(a, state).df).withColumnRenamed("v", "p")
    want = a.df.groupBy("i").agg((-F.sum(F.when(F.col("i") != F.col("j"), F.col("v"))) / F.max(F.when(F.col("i") == F.col("j"), F.col("v")))).alias("t"))
    return state.join(want, "i").join(sums, "i").select("i", (F.abs(F.col("p") - F.when(F.col("state") == 1, 1.0).otherwise(F.col("t"))) < 1e-9).alias("ok"))


add("amg_coarsen_mis2", lambda s, d: _roots(a := grid(s, d)[0], multigrid.aggregate_mis2(a)), _ROOTS.format(n=CELLS))
add("amg_coarsen_agg", lambda s, d: _roots(a := grid(s, d)[0], multigrid.aggregate_sequential(a)), _ROOTS.format(n=CELLS))
add("amg_coarsen_onepass", lambda s, d: _fine(a := grid(s, d)[0], multigrid.coarsen_onepass(a)), f"SELECT i, true AS ok FROM range({CELLS}) t(i)")
add("amg_influence", lambda s, d: multigrid.influence(grid(s, d)[0], 0.1), "SELECT i, j FROM grid JOIN (SELECT i, min(v) AS lo FROM grid WHERE i <> j GROUP BY i) USING (i) WHERE i <> j AND v <= 0.1e0 * lo", _AT_GRID)
add("amg_interp_agg", lambda s, d: matrix.row_sums(multigrid.interpolate_aggregates(a := grid(s, d)[0], multigrid.aggregate_mis2(a)).df), f"SELECT i, 1.0::DOUBLE AS v FROM range({CELLS}) t(i)")
add("amg_interp_sa", as_vec(lambda s, d: matrix.row_sums(multigrid.interpolate_smoothed(a := grid(s, d)[0], multigrid.aggregate_mis2(a), 0.5).df).withColumn("v", F.col("v") / 3.14159265), 6), f"SELECT i, {R('(1 - 0.5e0 * sum(v) / max(CASE WHEN i = j THEN v END)) / 3.14159265e0', 6)} AS v FROM grid GROUP BY i", _AT_GRID)
add("amg_interp_direct", _direct_sums, f"SELECT i, true AS ok FROM range({CELLS}) t(i)")
_STEP = "SELECT x.i, x.v + 0.7 * (r.v - t.v) / g.v AS v FROM x{k} x JOIN r USING (i) JOIN grid g ON g.i = x.i AND g.j = x.i JOIN (SELECT grid.i, sum(grid.v * y.v) AS v FROM grid JOIN x{k} y ON y.i = grid.j GROUP BY grid.i) t ON t.i = x.i"
WITH["r"], WITH["x0"] = _RHS, "SELECT i, 0.0e0 AS v FROM cell"
for _k in range(3):
    WITH[f"x{_k + 1}"] = _STEP.format(k=_k)
add("smooth_jacobi", as_vec(lambda s, d: multigrid.smooth_jacobi(*(g := grid(s, d))[:1], g[1].df, sources.zero_vector(s, CELLS).df, 0.7, 3), 6), f"SELECT i, {R('v', 6)} AS v FROM x3", f"{_AT_GRID} r x0 x1 x2 x3")

# ---- spectra ------------------------------------------------------------------------------------------------------
def _moments(s, values) -> DataFrame:
    """(k, moment): the sums of the powers 1 to 8 of a spectrum of the Gram matrix, each root taken."""
    return spectral.to_frame(s, np.array([np.sum(np.asarray(values, float) ** k) ** (1.0 / k) for k in range(1, 9)]))


def _spectrum(fn):
    return lambda s, d: rounded(_moments(s, fn(G(s, d))), 4)


WITH["g2"] = "SELECT a.i, b.j, sum(a.v * b.v) AS v FROM g a JOIN g b ON a.j = b.i GROUP BY 1, 2"
WITH["g3"] = "SELECT a.i, b.j, sum(a.v * b.v) AS v FROM g2 a JOIN g b ON a.j = b.i GROUP BY 1, 2"
WITH["g4"] = "SELECT a.i, b.j, sum(a.v * b.v) AS v FROM g2 a JOIN g2 b ON a.j = b.i GROUP BY 1, 2"
_FACTORS = {1: ("g", None), 2: ("g", "g"), 3: ("g2", "g"), 4: ("g2", "g2"), 5: ("g3", "g2"), 6: ("g3", "g3"), 7: ("g4", "g3"), 8: ("g4", "g4")}
_MOMENTS = " UNION ALL ".join(
    f"SELECT {k - 1} AS k, {R(f'pow(sum(a.v), 1.0 / {k})')} AS value FROM {a} a WHERE a.i = a.j" if b is None else f"SELECT {k - 1} AS k, {R(f'pow(sum(a.v * b.v), 1.0 / {k})')} AS value FROM {a} a JOIN {b} b ON a.i = b.j AND a.j = b.i"
    for k, (a, b) in _FACTORS.items()
)
_AT_MOMENTS = "e g g2 g3 g4"

# the Gram matrix multiplied by itself nine times over, scaled by its trace: its largest eigenvalue is all that is left
for _k in range(10):
    WITH[f"t{_k}"] = f"SELECT i, j, v / (SELECT sum(v) FROM {f'p{_k}' if _k else 'g'} WHERE i = j) AS v FROM {f'p{_k}' if _k else 'g'}"
    WITH[f"p{_k + 1}"] = f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM t{_k} a JOIN t{_k} b ON a.j = b.i GROUP BY 1, 2"
_POWERS = "e g " + " ".join(f"t{k} p{k + 1}" for k in range(9)) + " t9"
add("eig_power", lambda s, d: rounded(spectral.to_frame(s, np.array([spectral.power_iteration(G(s, d), 1e-12)[0]])), 3), f"SELECT 0 AS k, {R('(SELECT sum(g.v * t9.v) FROM g JOIN t9 ON g.i = t9.j AND g.j = t9.i) / (SELECT sum(v) FROM t9 WHERE i = j)', 3)} AS value", _POWERS)
_TOP = f"SELECT 0 AS k, {R('(SELECT sum(g.v * t9.v) FROM g JOIN t9 ON g.i = t9.j AND g.j = t9.i) / (SELECT sum(v) FROM t9 WHERE i = j)', 3)} AS value"
add("eig_lanczos", _spectrum(lambda g: spectral.lanczos(g, 64, 64)), _MOMENTS, _AT_MOMENTS)
add("eig_lanczos_partial", lambda s, d: rounded(spectral.to_frame(s, spectral.lanczos(G(s, d), 1, 60, "partial")), 3), _TOP, _POWERS)
add("top_eig", lambda s, d: rounded(spectral.to_frame(s, spectral.eigen_symmetric(G(s, d))[0][:1]), 3), _TOP, _POWERS)
# blocks of 16 rows, so that the Gram matrix has several
add("eig_qr_sym", _spectrum(lambda g: [r.value for r in jacobi.eigen(g, 16)[0].collect()]), _MOMENTS, _AT_MOMENTS)


def _row_scaled(g: Mat) -> Mat:
    """G with every row over its diagonal: not symmetric, with a real spectrum."""
    diagonal = g.df.where("i = j").select("i", F.col("v").alias("d"))
    return Mat(g.df.join(diagonal, "i").select("i", "j", (F.col("v") / F.col("d")).alias("v")), g.m, g.n)


for _k, _from in (("g", "SELECT g.i, g.j, g.v / d.v AS v FROM g JOIN g d ON d.i = g.i AND d.j = g.i"), ("g2", WITH["g2"]), ("g3", WITH["g3"]), ("g4", WITH["g4"])):
    WITH["u" + _k] = _from if _k == "g" else _from.replace("g2 ", "ug2 ").replace("FROM g ", "FROM ug ").replace("JOIN g ", "JOIN ug ")
_U_MOMENTS = _MOMENTS
for _k in ("g4", "g3", "g2", "g"):
    for _w in ("FROM ", "JOIN "):
        _U_MOMENTS = _U_MOMENTS.replace(f"{_w}{_k} ", f"{_w}u{_k} ")
add("eig_qr_nsm", lambda s, d: rounded(_moments(s, spectral.eigen_general(_row_scaled(G(s, d)))[0]), 4), _U_MOMENTS, "e g ug ug2 ug3 ug4")


def _band(g: Mat) -> tuple[np.ndarray, np.ndarray]:
    """The tridiagonal form of the Gram matrix."""
    return spectral.tridiagonalize(sources.to_numpy(g))[:2]


add("eig_bisect", _spectrum(lambda g: [r.value for r in spectral.bisect_table(g.df.sparkSession, *_band(g), tol=1e-12).collect()]), _MOMENTS, _AT_MOMENTS)
add("eig_tql2", _spectrum(lambda g: spectral.tridiagonal_eigen(*_band(g))[0]), _MOMENTS, _AT_MOMENTS)
add("tridiag_reduce", lambda s, d: rounded(_tridiagonal_back(s, G(s, d))), f"SELECT i, j, {R('v')} AS v FROM g", "e g")


def _tridiagonal_back(s, g: Mat) -> DataFrame:
    """The Gram matrix from its tridiagonal form and the basis that led there."""
    diagonal, below, q = spectral.tridiagonalize(sources.to_numpy(g))
    t = np.diag(diagonal) + np.diag(below[1:], 1) + np.diag(below[1:], -1)
    return sources.matrix_from(s, q @ t @ q.T).df


def _inverse_iteration(s, d) -> DataFrame:
    """The Rayleigh quotient, over the Gram matrix, of the vector that inverse iteration finds for the largest value."""
    g = G(s, d)
    diagonal, below, q = spectral.tridiagonalize(sources.to_numpy(g))
    v = Vec(loop.checkpoint(sources.vector_from(s, q @ spectral.inverse_iteration(diagonal, below, spectral.tridiagonal_eigen(diagonal, below)[0][-1])).df), 64)
    return rounded(vector.dot(v.df, product.gemv(g, v).df).select(F.lit(0).alias("k"), F.col("v").alias("value")), 3)


add("lanczos_invit", _inverse_iteration, _TOP, _POWERS)


def _svd(s, d):
    u, sv, v = spectral.svd(E(s, d))
    return rounded(product.multiply(u, sources.matrix_from(s, sv[:, None] * v.T)).df)


add("svd", _svd, f"SELECT i, j, {R('v')} AS v FROM e", "e")


def _bidiagonal(s, d):
    """The embeddings from both bases of their bidiagonal form."""
    u, diag, above, v = bidiagonal.bidiagonalise(E(s, d))
    return rounded(product.multiply(u, sources.matrix_from(s, (np.diag(diag) + np.diag(above, 1)) @ v.T)).df)


def _svd_by_rotations(a: Mat) -> DataFrame:
    u, sv, v = bidiagonal.svd(a)
    return product.multiply(u, sources.matrix_from(a.df.sparkSession, sv[:, None] * v.T)).df


def _cells_again(rows, u, sv, cols, v) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of U diag(s) V^T, without those that the query's own bound leaves out after rounding."""
    x = (u * sv) @ v.T
    i, j = np.nonzero(np.abs(x) > 9e-4)
    return rows[i], cols[j], x[i, j]


add("bidiag", _bidiagonal, f"SELECT i, j, {R('v')} AS v FROM e", "e")
add("svd_rotations", as_vec(lambda s, d: _svd_by_rotations(E(s, d))), f"SELECT i, j, {R('v')} AS v FROM e", "e")
# parts x suppliers, whose connected parts are decomposed side by side
add("svd_long", lambda s, d: rounded(bidiagonal.svd_parts(B(s, d), _cells_again, "i long, j long, v double")).where("abs(v) > 1e-3"), f"SELECT i, j, {R('v')} AS v FROM b", "b")


def _nmf(s, d):
    """A matrix of rank 3 from parts and nations, factored from fixed starts to the operator's own stopping rule."""
    t = loop.checkpoint(table(s, d, "part").selectExpr("p_partkey - 1 AS i", "p_size", "p_retailprice").where("i >= 0 AND i < 200").withColumn("w", F.expr("array(1 + p_size % 7, 1 + p_size % 5, p_retailprice / 500)")))
    known_h = "array(1 + j * 3 % 4, j % 3, 1 + j * 5 % 7)"
    v = t.select("i", "w", F.expr("explode(sequence(0L, 39L)) AS j")).withColumn("h", F.expr(known_h)).select("i", "j", F.expr("w[0] * h[0] + w[1] * h[1] + w[2] * h[2] AS v"))
    v = Mat(loop.checkpoint(v), 200, 40)
    start = lambda a, b, k: Mat(s.range(a).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(b - 1).cast("bigint"))).alias("j")).withColumn("v", 1 + (F.col("i") * k + F.col("j") * 5) % 7 / 7), a, b)
    w, h, *_ = spectral.nmf(v, 3, start(200, 3, 3), start(3, 40, 2), tol=3e-3, every=10)
    top = v.df.agg(F.max("v")).first()[0]
    both = v.df.join(product.multiply(w, h).df.withColumnRenamed("v", "p"), ["i", "j"])
    return both.select("i", "j", (F.abs(F.col("v") - F.col("p")) < 0.03 * top).alias("close"))


add("nmf", _nmf, "SELECT p_partkey - 1 AS i, j, true AS close FROM part, range(40) t(j) WHERE p_partkey - 1 >= 0 AND p_partkey - 1 < 200")

# ---- Fourier ------------------------------------------------------------------------------------------------------
def _signal(s, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(s, d, "events").select(F.col("user_id").alias("batch"), k.cast("bigint").alias("k"), F.col("value").alias("re"), (F.col("value") % 7).alias("im"))


_SIG = "sig AS (SELECT user_id AS batch, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, value AS re, fmod(value, 7) AS im FROM events), sn AS (SELECT *, count(*) OVER (PARTITION BY batch) AS n FROM sig)"
_DFT = f"WITH {_SIG} SELECT p.batch, q.k, {R('sum(p.re * cos(2 * pi() * ((p.k * q.k) % p.n) / p.n) + p.im * sin(2 * pi() * ((p.k * q.k) % p.n) / p.n))', 3)} AS re, {R('sum(p.im * cos(2 * pi() * ((p.k * q.k) % p.n) / p.n) - p.re * sin(2 * pi() * ((p.k * q.k) % p.n) / p.n))', 3)} AS im FROM sn p JOIN sn q ON p.batch = q.batch GROUP BY p.batch, q.k"
add("fft", as_vec(lambda s, d: fourier.fft(_signal(s, d)), 3), _DFT)
add("fft_bluestein", as_vec(lambda s, d: fourier.bluestein(_signal(s, d)), 3), _DFT)
add("ifft", as_vec(lambda s, d: fourier.ifft(fourier.fft(_signal(s, d))), 3), f"WITH {_SIG} SELECT batch, k, {R('re', 3)} AS re, {R('im', 3)} AS im FROM sig")
add("convolve", as_vec(lambda s, d: fourier.convolve(_signal(s, d).withColumn("im", F.lit(0.0)), _signal(s, d).withColumn("im", F.lit(0.0)), 0).select("batch", "k", (F.col("re") / 3141.59265).alias("re")), 4), f"WITH {_SIG} SELECT p.batch, (p.k + q.k) % p.n AS k, {R('sum(p.re * q.re) / 3141.59265', 4)} AS re FROM sn p JOIN sn q ON p.batch = q.batch GROUP BY 1, 2")


def _months(s, d):
    return table(s, d, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("bigint").alias("i"), (F.month("l_shipdate") - 1).cast("bigint").alias("j")).agg((F.sum("l_quantity") / 1000).alias("re")).withColumn("im", F.lit(0.0))


add("fft2", as_vec(lambda s, d: fourier.fft2(_months(s, d)), 3), f"""
WITH t AS (SELECT l_linenumber - 1 AS i, month(l_shipdate) - 1 AS j, sum(l_quantity) / 1000 AS v FROM lineitem GROUP BY 1, 2), n AS (SELECT max(i) + 1 AS m, max(j) + 1 AS n FROM t)
SELECT p.i::BIGINT AS i, p.j::BIGINT AS j, {R('sum(q.v * cos(2 * pi() * (p.i * q.i / m + p.j * q.j / n)))', 3)} AS re, {R('-sum(q.v * sin(2 * pi() * (p.i * q.i / m + p.j * q.j / n)))', 3)} AS im FROM t p, t q, n GROUP BY 1, 2""")


def _reversed_bits(s, d) -> DataFrame:
    x = X(s, d)
    return fourier.bit_reversal(x.df.select(F.col("i").alias("k"), F.col("v").alias("re")), max(1, (x.n - 1).bit_length()))


_BITS = "CAST(greatest(1, ceil(log2(n))) AS BIGINT)"
add("fft_reorder", _reversed_bits, f"SELECT CAST(list_sum(list_transform(range({_BITS}), lambda b: ((i >> CAST(b AS INTEGER)) & 1) << CAST({_BITS} - 1 - b AS INTEGER))) AS BIGINT) AS k, v AS re FROM x, np", "x np")
_dft_sp = lambda s, d: _scaled(s, d).df.select(F.lit(0).cast("bigint").alias("batch"), F.col("i").alias("k"), (F.col("v") / 3.14159265).alias("re"), F.lit(0.0).alias("im"))
add("dft_definition", as_vec(lambda s, d: fourier.dft(_dft_sp(s, d), S(s, d).n), 4), f"SELECT 0::BIGINT AS batch, q.k, {R('sum(p.v / 3.14159265e0 * cos(2 * pi() * (p.i * q.k % n) / n))')} AS re, {R('-sum(p.v / 3.14159265e0 * sin(2 * pi() * (p.i * q.k % n) / n))')} AS im FROM sp p, sn, range(n) q(k) GROUP BY q.k", "sp sn")
_long_sp = lambda s, d: fourier.long_fft(X(s, d).df.select(F.col("i").alias("k"), (F.col("v") / 3141.59265).alias("re"), F.lit(0.0).alias("im")), X(s, d).n)
add("long_fft", as_vec(lambda s, d: _long_sp(s, d), 3), f"SELECT q.k, {R('sum(x.v / 3141.59265e0 * cos(2 * pi() * (x.i * q.k % n) / n))', 3)} AS re, {R('-sum(x.v / 3141.59265e0 * sin(2 * pi() * (x.i * q.k % n) / n))', 3)} AS im FROM x, np, range(n) q(k) GROUP BY q.k", "x np")

# ---- orderings ----------------------------------------------------------------------------------------------------
add("bandwidth", lambda s, d: matrix.bandwidth(A(s, d).df), "SELECT max(abs(i - j)) AS bandwidth FROM a", "a")


def _reverse(s, n):
    return s.range(n).select(F.col("id").alias("i"), (n - 1 - F.col("id")).alias("p"))


add("permute", lambda s, d: matrix.permute(G(s, d).df, _reverse(s, 64)).transform(rounded), f"SELECT 63 - i AS i, 63 - j AS j, {R('v')} AS v FROM g", "e g")


def _ordering(fn):
    def run(s, d):
        a = grid(s, d)[0]
        shuffled = Mat(loop.checkpoint(matrix.permute(a.df, s.range(CELLS).select(F.col("id").alias("i"), ((F.col("id") * 1021 + 3) % CELLS).alias("p")))), CELLS, CELLS)
        p = loop.checkpoint(fn(shuffled))
        after = matrix.bandwidth(matrix.permute(shuffled.df, p)).withColumnRenamed("bandwidth", "after")
        before = matrix.bandwidth(shuffled.df).withColumnRenamed("bandwidth", "before")
        return p.agg(F.countDistinct("i").alias("rows"), F.countDistinct("p").alias("places")).crossJoin(before).crossJoin(after).select("rows", "places", "before", (F.col("after") <= PX + 2).alias("narrow"))

    return run


_MOVED = f"(i * 1021 + 3) % {CELLS}"
for _n, _f in (("reorder_cm", reorder.cuthill_mckee), ("reorder_acm", reorder.advanced_cuthill_mckee), ("reorder_gps", reorder.gibbs_poole_stockmeyer)):
    add(_n, _ordering(_f), f"SELECT {CELLS}::BIGINT AS rows, {CELLS}::BIGINT AS places, max(abs({_MOVED} - {_MOVED.replace('i *', 'j *')})) AS before, true AS narrow FROM grid", _AT_GRID)


def bought_together(s, d) -> Mat:
    """The whole lineitem table's graph of parts that occur in one order, its weights how often."""
    line = table(s, d, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("o"), F.col("l_partkey").cast("bigint").alias("p")).repartition("o").distinct()
    pairs = line.join(line.withColumnRenamed("p", "q"), "o").where("p > q").select(F.col("p").alias("i"), F.col("q").alias("j"))
    n = size(table(s, d, "part"), "p_partkey")
    # half of the graph, by row, is stored; the other half is its transpose
    low = loop.stored(pairs.repartition("i").groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("v")))
    return Mat(low.unionByName(Mat(low, n, n).T.df), n, n)


_PARTS = "SELECT n AS rows, n AS places, true AS no_wider FROM np"


def _order_parts(s, d, fn) -> DataFrame:
    g = bought_together(s, d)
    p = loop.checkpoint(fn(g, symmetric=True))
    both = matrix.bandwidths(Mat(matrix.lower(g.df), g.n, g.n), p)  # of one half, as the graph is symmetric
    return p.agg(F.countDistinct("i").alias("rows"), F.countDistinct("p").alias("places")).crossJoin(before).crossJoin(after).select("rows", "places", "before", (F.col("after") <= PX + 2).alias("narrow"))

    return run


_MOVED = f"(i * 1021 + 3) % {CELLS}"
for _n, _f in (("reorder_cm", reorder.cuthill_mckee), ("reorder_acm", reorder.advanced_cuthill_mckee), ("reorder_gps", reorder.gibbs_poole_stockmeyer)):
    add(_n, _ordering(_f), f"SELECT {CELLS}::BIGINT AS rows, {CELLS}::BIGINT AS places, max(abs({_MOVED} - {_MOVED.replace('i *', 'j *')})) AS before, true AS narrow FROM grid", _AT_GRID)


def bought_together(s, d) -> Mat:
    """The whole lineitem table's graph of parts that occur in one order, its weights how often."""
    line = table(s, d, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("o"), F.col("l_partkey").cast("bigint").alias("p")).repartition("o").distinct()
    pairs = line.join(line.withColumnRenamed("p", "q"), "o").where("p > q").select(F.col("p").alias("i"), F.col("q").alias("j"))
    n = size(table(s, d, "part"), "p_partkey")
    # half of the graph, by row, is stored; the other half is its transpose
    low = loop.stored(pairs.repartition("i").groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("v")))
    return Mat(low.unionByName(Mat(low, n, n).T.df), n, n)


_PARTS = "SELECT n AS rows, n AS places, true AS no_wider FROM np"


def _order_parts(s, d, fn) -> DataFrame:
    g = bought_together(s, d)
    p = loop.checkpoint(fn(g, symmetric=True))
    width = lambda m, name: matrix.bandwidth(m).withColumnRenamed("bandwidth", name)
    both = width(g.df, "before").crossJoin(width(matrix.permute(g.df, p, g.n), "after"))
    return p.agg(F.countDistinct("i").alias("rows"), F.countDistinct("p").alias("places")).crossJoin(both).select("rows", "places", F.coalesce(F.col("after") <= F.col("before"), F.lit(True)).alias("no_wider"))


for _n, _f in (("reorder_acm", reorder.advanced_cuthill_mckee), ("reorder_gps", reorder.gibbs_poole_stockmeyer)):
    add(f"{_n}_parts", lambda s, d, f=_f: _order_parts(s, d, f), _PARTS, "np")


def _places_sql(layers: int = 12) -> str:
    """Places of the breadth-first ordering, for a graph whose nodes are alone or in one component of so many layers."""
    parts = [
        "line AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), e AS (SELECT DISTINCT a.p AS i, b.p AS j FROM line a JOIN line b USING (o) WHERE a.p <> b.p)",
        "d AS (SELECT r.i, count(e.j) AS degree FROM (SELECT max(p_partkey) + 1 AS n FROM part), range(n) r(i) LEFT JOIN e ON e.i = r.i GROUP BY r.i)",
        "v0 AS (SELECT i, row_number() OVER (ORDER BY degree, i) - 1 AS p FROM d QUALIFY degree = 0 OR sum(CASE WHEN degree > 0 THEN 1 ELSE 0 END) OVER (ORDER BY degree, i) = 1)",
    ]
    for k in range(layers):
        new = f"SELECT e.j AS i, min(v.p) AS parent FROM v{k} v JOIN e USING (i) WHERE e.j NOT IN (SELECT i FROM v{k}) GROUP BY e.j"
        parts.append(f"v{k + 1} AS MATERIALIZED (SELECT i, p FROM v{k} UNION ALL SELECT n.i, (SELECT count(*) FROM v{k}) + row_number() OVER (ORDER BY parent, degree, n.i) - 1 AS p FROM ({new}) n JOIN d USING (i))")
    return "WITH " + ", ".join(parts) + f" SELECT i, p FROM v{layers}"


add("reorder_cm_parts", lambda s, d: reorder.cuthill_mckee(bought_together(s, d), symmetric=True), _places_sql())
for _n, _f in (("mis2", multigrid.aggregate_mis2), ("agg", lambda g: multigrid.aggregate_sequential(g, True))):
    add(f"amg_coarsen_{_n}_parts", lambda s, d, f=_f: _roots(g := bought_together(s, d), f(g)), "SELECT i, true AS near, true AS apart FROM np, range(n) t(i)", "np")
add("sort_deg", lambda s, d: reorder.by_degree(bought_together(s, d)), "SELECT i, degree, row_number() OVER (ORDER BY degree, i) - 1 AS p FROM (SELECT r.i, count(c.q) AS degree FROM np, range(n) r(i) LEFT JOIN (SELECT DISTINCT a.l_partkey AS i, b.l_partkey AS q FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey) c ON c.i = r.i GROUP BY r.i)", "np")
