"""Eigenvalues, singular values and non-negative factorization.

Products with the matrix are distributed; problems of the size of the Krylov space or of the number of columns (bounded
by types.LOCAL_ENTRIES cells) are solved on the driver with numpy. Vectors (and factors of few columns) of at most
types.DRIVER_ROWS entries are arrays on the driver, as in plans.solvers; longer ones are tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axolin.operators.product import gemv, multiply
from axolin.plans.blocks import as_vec, packed, to_array
from axolin.plans.loop import State, checkpoint
from axolin.sources import to_numpy
from axolin.types import DRIVER_ROWS, LOCAL_ENTRIES, Mat, Vec, driver_sized, need, small


def power_iteration(a: Mat, tol: float = 1e-8, most: int = 50_000) -> tuple[float, Vec, int]:
    """(|largest eigenvalue|, unit vector, iterations); the start vector is (i mod 3) 0.1234 - 0.5, the sign is lost."""
    if driver_sized(a.n):
        return _power_arrays(a, tol, most)
    x = a.df.sparkSession.range(a.n).select(F.col("id").alias("i"), ((F.col("id") % 3) * 0.1234 - 0.5).alias("v"))
    norm = x.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0]
    state, k, value = State(x.withColumn("v", F.col("v") / norm), a.n), 0, 0.0
    for k in range(1, most + 1):
        y = State(gemv(a, Vec(state.df, a.n)).df, a.n)
        norm = y.df.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)))).first()[0]
        if norm == 0:
            return 0.0, Vec(state.done(), a.n), k
        state.step(y.df.withColumn("v", F.col("v") / norm))
        state.settle()
        y.df.unpersist()
        old, value = value, norm
        if abs(value - old) < tol * abs(value):
            break
    return value, Vec(state.done(), a.n), k


def _power_arrays(a: Mat, tol: float, most: int) -> tuple[float, Vec, int]:
    spark, part, value, k = a.df.sparkSession, packed(a), 0.0, 0
    x = np.arange(a.n) % 3 * 0.1234 - 0.5
    x /= np.linalg.norm(x)
    for k in range(1, most + 1):
        y = part.times(x)
        old, value = value, float(np.linalg.norm(y))
        if value == 0:
            return 0.0, as_vec(spark, y), k
        x = y / value
        if abs(value - old) < tol * abs(value):
            break
    part.release()
    return value, as_vec(spark, x), k


def tridiagonal_eigen(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and vectors of a symmetric tridiagonal matrix; e[0] is unused."""
    return np.linalg.eigh(np.diag(d) + np.diag(e[1:], 1) + np.diag(e[1:], -1))


def inverse_iteration(d: np.ndarray, e: np.ndarray, value: float, steps: int = 3) -> np.ndarray:
    """A unit eigenvector of a tridiagonal matrix for a known eigenvalue."""
    t = np.diag(d - value - 1e-10 * max(1.0, abs(value))) + np.diag(e[1:], 1) + np.diag(e[1:], -1)
    x = np.ones(len(d)) / len(d) ** 0.5
    for _ in range(steps):
        x = np.linalg.solve(t, x)
        x /= np.linalg.norm(x)
    return x


def bisect(d: np.ndarray, e: np.ndarray, tol: float = 1e-6) -> np.ndarray:
    """Ascending eigenvalues of a symmetric tridiagonal matrix, all intervals halved together by counts of negative pivots."""
    n = len(d)
    radius = np.abs(np.append(e[1:], 0)) + np.abs(np.append(0, e[1:]))
    lo, hi = np.full(n, (d - radius).min()), np.full(n, (d + radius).max())
    k = np.arange(n)
    while (hi - lo).max() > tol:
        mid, below, q = (lo + hi) / 2, np.zeros(n, int), np.ones(n)
        for i in range(n):
            q = d[i] - mid - (e[i] ** 2 / q if i else 0)
            q = np.where(q == 0, 1e-300, q)
            below += q < 0
        left = below > k
        hi, lo = np.where(left, mid, hi), np.where(left, lo, mid)
    return (lo + hi) / 2


def bisect_table(spark: SparkSession, d: np.ndarray, e: np.ndarray, tol: float = 1e-10, parts: int | None = None) -> DataFrame:
    """(k, value), ascending, of a symmetric tridiagonal matrix; e[0] is unused. The range of all values is cut into
    intervals, one row each, which tasks take side by side: the number of negative pivots at both ends tells which values
    an interval holds, and it is halved until each of them has its own, narrow one. The band is broadcast (16 bytes a row)."""
    n = len(d)
    need(n <= DRIVER_ROWS, "the band must fit the driver")
    if not n:
        return spark.createDataFrame([], "k int, value double")
    parts = parts or 4 * spark.sparkContext.defaultParallelism
    radius = np.abs(np.append(e[1:], 0)) + np.abs(np.append(0, e[1:]))
    lo, hi = float((d - radius).min()), float((d + radius).max())
    pad = 1e-12 * max(abs(lo), abs(hi), 1e-300)
    edges = np.linspace(lo - pad, hi + pad, parts + 1)
    band = spark.sparkContext.broadcast((np.asarray(d, float), np.asarray(e, float) ** 2))
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(edges, edges[1:], strict=False)], "lo double, hi double").repartition(parts)

    def below(x: np.ndarray) -> np.ndarray:
        """How many values are less than each x."""
        diagonal, squares = band.value
        count, q = np.zeros(len(x), int), np.ones(len(x))
        for i in range(len(diagonal)):
            q = diagonal[i] - x - (squares[i] / q if i else 0)
            q = np.where(q == 0, 1e-300, q)
            count += q < 0
        return count

    def run(frames):
        for pdf in frames:
            for a, b in zip(pdf["lo"], pdf["hi"], strict=True):
                first, last = below(np.array([a, b]))
                k = np.arange(first, last)
                lo, hi = np.full(len(k), a), np.full(len(k), b)
                while len(k) and (hi - lo).max() > tol * max(1.0, abs(a), abs(b)):
                    mid = (lo + hi) / 2
                    points, at = np.unique(mid, return_inverse=True)
                    left = below(points)[at] > k
                    hi, lo = np.where(left, mid, hi), np.where(left, lo, mid)
                yield pd.DataFrame({"k": k.astype(np.int32), "value": (lo + hi) / 2})

    return rows.mapInPandas(run, "k int, value double")


def lanczos(a: Mat, k: int = 10, krylov: int = 100, method: str = "full", seed: int = 0, vectors: bool = False):
    """The k largest eigenvalues of a symmetric matrix, descending, from a Krylov space; with vectors a table (i, k, v) as well.

    The basis is one table with a column for each vector. Methods: full (against all, twice), partial (against all when
    the estimated loss of orthogonality passes the square root of the machine precision), none.
    """
    need(method in ("full", "partial", "none"), "method is full, partial or none")
    krylov = min(krylov, a.n)
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "id")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    start = a.df.sparkSession.range(a.n).select(F.col("id").alias("i"), (u + 0.5).alias("q0"))
    if a.n * (krylov + 1) <= 8 * DRIVER_ROWS:
        return _lanczos_arrays(a, to_array(start.withColumnRenamed("q0", "v"), a.n), k, krylov, method, vectors)
    norm = start.agg(F.sqrt(F.sum(F.col("q0") ** 2))).first()[0]
    basis, alpha, beta = State(start.withColumn("q0", F.col("q0") / norm), a.n), [], [0.0]
    was, now = np.zeros(1), np.ones(1)  # estimated products with the basis
    for m in range(krylov):
        y = gemv(a, Vec(basis.df.select("i", F.col(f"q{m}").alias("v")), a.n)).df
        w = State(basis.df.join(small(y, a.n), "i", "left").withColumn("w", F.coalesce("v", F.lit(0.0))).drop("v"), a.n)
        al = w.df.agg(F.sum(F.col("w") * F.col(f"q{m}"))).first()[0]
        alpha.append(al)
        less = F.col("w") - al * F.col(f"q{m}") - (beta[m] * F.col(f"q{m - 1}") if m else 0)
        w.near(w.df.withColumn("w", less))
        new = np.append((np.abs(al) + 1) * np.append(now, 1)[: m + 1] + np.append(was, 0)[: m + 1], 1) * 1e-16 * (m + 1)
        if method == "full" or (method == "partial" and new[:-1].sum() * a.n**0.5 > 1e-8):
            for _ in range(2):
                c = w.df.agg(*[F.sum(F.col(f"q{j}") * F.col("w")) for j in range(m + 1)]).first()
                less = F.col("w")
                for j, cj in enumerate(c):
                    less = less - cj * F.col(f"q{j}")
                w.near(w.df.withColumn("w", less))
        was, now = now, new
        be = w.df.agg(F.sqrt(F.sum(F.col("w") ** 2))).first()[0]
        w.settle()
        if m == krylov - 1 or be < 1e-12 * max(map(abs, alpha)):
            break
        beta.append(be)
        basis.step(w.df.withColumn(f"q{m + 1}", F.col("w") / be).drop("w"))
        basis.settle()
        w.df.unpersist()
    values, z = tridiagonal_eigen(np.array(alpha), np.array(beta))
    top = np.argsort(values)[::-1][:k]
    if not vectors:
        return values[top]
    cols = []
    for rank, t in enumerate(top):
        total = F.lit(0.0)
        for j in range(len(alpha)):
            total = total + float(z[j, t]) * F.col(f"q{j}")
        cols.append(F.struct(F.lit(rank).alias("k"), total.alias("v")))
    return values[top], basis.df.select("i", F.explode(F.array(*cols)).alias("e")).select("i", "e.k", "e.v")


def _lanczos_arrays(a: Mat, x: np.ndarray, k: int, krylov: int, method: str, vectors: bool):
    """The same with the basis as an array of at most 8 DRIVER_ROWS cells."""
    part, q, alpha, beta = packed(a), np.zeros((a.n, krylov)), [], [0.0]
    q[:, 0] = x / np.linalg.norm(x)
    was, now = np.zeros(1), np.ones(1)
    for m in range(krylov):
        w = part.times(q[:, m])
        alpha.append(float(w @ q[:, m]))
        w = w - alpha[m] * q[:, m] - (beta[m] * q[:, m - 1] if m else 0)
        new = np.append((abs(alpha[m]) + 1) * np.append(now, 1)[: m + 1] + np.append(was, 0)[: m + 1], 1) * 1e-16 * (m + 1)
        if method == "full" or (method == "partial" and new[:-1].sum() * a.n**0.5 > 1e-8):
            for _ in range(2):
                w = w - q[:, : m + 1] @ (q[:, : m + 1].T @ w)
        was, now = now, new
        size = float(np.linalg.norm(w))
        if m == krylov - 1 or size < 1e-12 * max(map(abs, alpha)):
            break
        beta.append(size)
        q[:, m + 1] = w / size
    part.release()
    values, z = tridiagonal_eigen(np.array(alpha), np.array(beta))
    top = np.argsort(values)[::-1][:k]
    if not vectors:
        return values[top]
    made = q[:, : len(alpha)] @ z[:, top]
    cells = pd.DataFrame({"i": np.repeat(np.arange(a.n), len(top)), "k": np.tile(np.arange(len(top)), a.n).astype(np.int32), "v": made.ravel()})
    return values[top], a.df.sparkSession.createDataFrame(cells, "i long, k int, v double")


def eigen_symmetric(a: Mat) -> tuple[np.ndarray, np.ndarray]:
    """Descending eigenvalues and vectors of a small dense symmetric matrix."""
    values, vectors = np.linalg.eigh(to_numpy(a))
    return values[::-1], vectors[:, ::-1]


def eigen_general(a: Mat) -> tuple[np.ndarray, np.ndarray]:
    """(real parts, imaginary parts), in descending order of the real part, then the imaginary one."""
    values = np.linalg.eigvals(to_numpy(a))
    order = np.lexsort((-values.imag, -values.real))
    return values.real[order], values.imag[order]


def tridiagonalize(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, e, Q) with Q^T A Q tridiagonal, by two-sided reflections."""
    a, n = a.astype(float).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        s = np.linalg.norm(x)
        if s == 0:
            continue
        x /= s
        a[k + 1 :] -= 2 * np.outer(x, x @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.append(0, np.diag(a, -1)), q


def gram(a: Mat) -> Mat:
    """A^T A."""
    return multiply(a.T, a)


def svd(a: Mat) -> tuple[Mat, np.ndarray, np.ndarray]:
    """(U, singular values descending, V) by A = Q R and the singular values of R, so that small ones keep their digits;
    singular values under 1e-13 of the largest have no column in U, whose columns are orthonormal."""
    from axolin.operators.reflectors import factor

    need(a.n * a.n <= LOCAL_ENTRIES, "too many columns")
    f = factor(a)
    left, s, right = np.linalg.svd(f.r)
    s = np.append(s, np.zeros(a.n - len(s)))
    rank = int((s > 1e-13 * max(s[0] if len(s) else 0.0, 1e-300)).sum())
    u = f.times(np.ascontiguousarray(left[:, :rank])) if f.levels else Mat(a.df, a.m, 0)
    return u, s, right.T


def nmf(v: Mat, k: int, w: Mat | None = None, h: Mat | None = None, tol: float = 1e-4, stagnation: float = 1e-5, most: int = 10_000, every: int = 100) -> tuple[Mat, Mat, int, float]:
    """(W, H, iterations, relative error) of V close to W H, by multiplicative updates of H, then W.

    Quotients whose divisor is at most 1e-5 give 0; an absent start is all ones. (W^T W) H and W (H H^T) are taken in
    the order that makes no m x n product; W H is formed at checks only.
    """
    spark = v.df.sparkSession

    def ones(m: int, n: int) -> DataFrame:
        return spark.range(m).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("j"), F.lit(1.0).alias("v"))

    w = w or Mat(ones(v.m, k), v.m, k)
    h = h or Mat(ones(k, v.n), k, v.n)

    if (v.m + v.n) * k <= DRIVER_ROWS:
        return _nmf_arrays(v, to_numpy(w), to_numpy(h), tol, stagnation, most, every)

    def update(x: Mat, up: Mat, down: Mat) -> Mat:
        p = x.df.join(up.df.withColumnRenamed("v", "u"), ["i", "j"], "left").join(down.df.withColumnRenamed("v", "d"), ["i", "j"], "left")
        return Mat(checkpoint(p.select("i", "j", F.when(F.col("d") > 1e-5, F.col("v") * F.coalesce("u", F.lit(0.0)) / F.col("d")).otherwise(0.0).alias("v"))), x.m, x.n)

    def error() -> float:
        wh = multiply(w, h).df.withColumnRenamed("v", "p")
        d = v.df.join(wh, ["i", "j"], "full").agg(F.sqrt(F.sum((F.coalesce(F.col("v"), F.lit(0.0)) - F.coalesce("p", F.lit(0.0))) ** 2))).first()[0]
        return d / (v.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 1.0)

    last, still, it, err = None, 0, 0, error()
    for it in range(most):
        h = update(h, multiply(w.T, v), multiply(multiply(w.T, w), h))
        w = update(w, multiply(v, h.T), multiply(w, multiply(h, h.T)))
        if it % every == 0:
            err = error()
            still = still + 1 if last is not None and abs(last - err) < stagnation * max(err, 1e-300) else 0
            last = err
            if err < tol or still >= 2:
                break
    return w, h, it + 1, error()


def _nmf_arrays(v: Mat, w: np.ndarray, h: np.ndarray, tol: float, stagnation: float, most: int, every: int) -> tuple[Mat, Mat, int, float]:
    """The same with both factors on the driver: an update needs one product with V, which stays distributed. The error
    follows from the products as well: |V - W H|^2 = |V|^2 - 2 <W^T V, H> + <W^T W, H H^T>."""
    spark, part = v.df.sparkSession, packed(v)
    whole = float(v.df.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0)
    ratio = lambda x, up, down: np.where(down > 1e-5, x * up / np.where(down > 1e-5, down, 1.0), 0.0)

    def error() -> float:
        wv = part.times_t(w).T
        return float(max(0.0, whole - 2 * (wv * h).sum() + ((w.T @ w) * (h @ h.T)).sum()) ** 0.5 / (whole**0.5 or 1.0))

    last, still, it, err = None, 0, 0, 0.0
    for it in range(most):
        h = ratio(h, part.times_t(w).T, w.T @ w @ h)
        w = ratio(w, part.times(np.ascontiguousarray(h.T)), w @ (h @ h.T))
        if it % every == 0:
            err = error()
            still = still + 1 if last is not None and abs(last - err) < stagnation * max(err, 1e-300) else 0
            last = err
            if err < tol or still >= 2:
                break
    err = error()
    part.release()

    def table(x: np.ndarray) -> Mat:
        i, j = np.indices(x.shape)
        return Mat(spark.createDataFrame(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": x.ravel()}), "i long, j long, v double"), *x.shape)

    return table(w), table(h), it + 1, err


def to_frame(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """(k, value)."""
    return spark.createDataFrame(pd.DataFrame({"k": np.arange(len(values), dtype=np.int32), "value": np.asarray(values, float)}), "k int, value double")
