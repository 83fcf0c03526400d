"""Iterative solvers.

The matrix may be a Mat or any callable DataFrame -> DataFrame (matrix-free). Up to types.DRIVER_ROWS unknowns the
vectors of the loop are arrays on the driver and each product with the distributed matrix, or use of a preconditioner,
is one job (see plans.blocks). Beyond that, vectors live side by side in one state table (i, ...), so that the updates
of an iteration are one join with the product. A monitor gets (iteration, relative residual) and ends the loop by
returning True.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axolin.operators.product import gemv
from axolin.plans.blocks import as_vec, on_arrays, to_array
from axolin.plans.loop import State, Written, checkpoint, dealt
from axolin.types import Mat, Vec, driver_sized, small

Operator = Mat | Callable[[DataFrame], DataFrame]


@dataclass
class Result:
    x: Vec
    iterations: int
    error: float


def apply(a: Operator, x: DataFrame, n: int) -> DataFrame:
    """A x as (i, v)."""
    return gemv(a, Vec(x, n)).df if isinstance(a, Mat) else a(x)


def _with(state: DataFrame, y: DataFrame, name: str, n: int | None = None) -> DataFrame:
    """The state with the vector y as a further column; entries without a row are zero. y is broadcast if its known
    length is within the bound, and joined by shuffle otherwise."""
    return state.join(small(y.select("i", F.col("v").alias(name)), n), "i", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def _column(state: DataFrame, c: str) -> DataFrame:
    return state.select("i", F.col(c).alias("v"))


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def _start(b: Vec) -> DataFrame:
    return b.df.select("i", F.lit(0.0).alias("x"), F.col("v").alias("r"))


def _shifted(solve, a: Operator, b: Vec, x0: Vec | None, **kw) -> Result:
    """Solves A y = b - A x0 and returns x0 + y."""
    if x0 is None:
        return solve(a, b, **kw)
    rest = _with(_with(b.df.withColumnRenamed("v", "b"), apply(a, x0.df, b.n), "ax", b.n), x0.df, "x0", b.n)
    got = solve(a, Vec(rest.select("i", (F.col("b") - F.col("ax")).alias("v")), b.n), **kw)
    x = _with(got.x.df.withColumnRenamed("v", "y"), x0.df, "x0", b.n).select("i", (F.col("y") + F.col("x0")).alias("v"))
    return Result(Vec(x, b.n), got.iterations, got.error)


def _arrays(solve, a: Operator, b: Vec, x0: Vec | None, pre, **kw) -> Result:
    """Solves on arrays for the residual of x0."""
    spark = b.df.sparkSession
    times, right = on_arrays(a, spark, b.n), to_array(b.df, b.n)
    first = to_array(x0.df, b.n) if x0 is not None else 0.0
    rest = right - times(first) if x0 is not None else right
    x, k, error = solve(times, rest, on_arrays(pre, spark, b.n) if pre is not None else None, **kw)
    return Result(as_vec(spark, first + x), k, error)


def cg_arrays(times, b, pre, tol, most, monitor, abs_tol):
    """(x, iterations, error). The test is on the residual norm, with a preconditioner on <r, z>, relative to the first."""
    x, r = np.zeros_like(b), b.copy()
    z = pre(r) if pre else r
    p, rz = z.copy(), float(r @ z)
    first, k = rz, 0
    while k < most and rz != 0 and abs(rz) > abs_tol**2 and abs(rz) >= tol * tol * abs(first):
        ap = times(p)
        alpha = rz / float(p @ ap)
        x += alpha * p
        r -= alpha * ap
        z = pre(r) if pre else r
        new = float(r @ z)
        p = z + (new / rz) * p
        rz, k = new, k + 1
        if monitor and monitor(k, abs(rz / first) ** 0.5):
            break
    return x, k, abs(rz / first) ** 0.5 if first else 0.0


def bicgstab_arrays(times, b, pre, tol, most, monitor, restart):
    pre = pre or (lambda v: v)
    x, r = np.zeros_like(b), b.copy()
    norm, s0, p = float(b @ b), b.copy(), b.copy()
    rho, error = norm, 1.0
    if norm == 0:
        return x, 0, 0.0
    for k in range(1, most + 1):
        ph = pre(p)
        ap = times(ph)
        alpha = rho / float(s0 @ ap)
        s = r - alpha * ap
        sh = pre(s)
        t = times(sh)
        tt = float(t @ t)
        omega = float(t @ s) / tt if tt else 0.0
        x += alpha * ph + omega * sh
        r = s - omega * t
        new, rr = float(s0 @ r), float(r @ r)
        error = (rr / norm) ** 0.5
        if (monitor and monitor(k, error)) or error < tol or omega == 0:
            break
        if k % restart == 0 or abs(new) < 1e-30 * norm:
            s0, p, rho = r.copy(), r.copy(), rr
        else:
            p = r + (new / rho) * (alpha / omega) * (p - omega * ap)
            rho = new
    return x, k, error


def gmres_arrays(times, b, pre, tol, most, monitor, krylov):
    pre = pre or (lambda v: v)
    x, used, norm, error, stop = np.zeros_like(b), 0, None, 1.0, False
    while True:
        rest = pre(b - times(x) if used else b)
        beta = float(np.linalg.norm(rest))
        norm = beta if norm is None else norm
        if norm == 0:
            return x, 0, 0.0
        error = beta / norm
        if error < tol or used >= most or stop:
            return x, used, error
        q, h, m = np.zeros((len(b), krylov + 1)), np.zeros((krylov + 1, krylov)), 0
        q[:, 0] = rest / beta
        for k in range(min(krylov, most - used)):
            w = pre(times(q[:, k]))
            for _ in range(2):
                c = q[:, : k + 1].T @ w
                h[: k + 1, k] += c
                w = w - q[:, : k + 1] @ c
            h[k + 1, k] = np.linalg.norm(w)
            m = k + 1
            g = np.zeros(m + 1)
            g[0] = beta
            y, *_ = np.linalg.lstsq(h[: m + 1, :m], g, rcond=None)
            error = float(np.linalg.norm(g - h[: m + 1, :m] @ y)) / norm
            stop = bool(monitor and monitor(used + m, error))
            if error < tol or stop or h[k + 1, k] < 1e-14 * beta:
                break
            q[:, k + 1] = w / h[k + 1, k]
        used += m
        x = x + q[:, :m] @ y


def _reflected(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(I - 2 w w^T) x for a unit or zero w."""
    return x - 2.0 * float(w @ x) * w


def _reflector(x: np.ndarray, k: int) -> np.ndarray:
    """The unit w whose reflection clears x after its place k and leaves what is before it; zero if there is nothing."""
    w = np.zeros_like(x)
    size = float(np.linalg.norm(x[k:]))
    if size:
        w[k:] = x[k:]
        w[k] += np.copysign(size, x[k])
        w /= np.linalg.norm(w)
    return w


def gmres_reflector_arrays(times, b, pre, tol, most, monitor, krylov):
    """The basis as reflections: each vector is a product of reflections of a unit vector, so it is orthogonal to the others
    to the last digit, whatever the matrix; the reflections also take the products to the small system."""
    pre = pre or (lambda v: v)
    n, x, used, norm, error, stop = len(b), np.zeros_like(b), 0, None, 1.0, False
    krylov = min(krylov, n)
    while True:
        rest = pre(b - times(x) if used else b)
        size = float(np.linalg.norm(rest))
        norm = size if norm is None else norm
        if norm == 0:
            return x, 0, 0.0
        error = size / norm
        if error < tol or used >= most or stop:
            return x, used, error
        w, h, m = [_reflector(rest, 0)], np.zeros((krylov + 1, krylov)), 0
        beta, y = float(_reflected(w[0], rest)[0]), np.zeros(0)
        for k in range(min(krylov, most - used)):
            v = np.zeros(n)
            v[k] = 1.0
            for r in reversed(w):
                v = _reflected(r, v)
            v = pre(times(v))
            for r in w:
                v = _reflected(r, v)
            if k + 1 < n:
                w.append(_reflector(v, k + 1))
                v = _reflected(w[-1], v)
                h[k + 1, k] = v[k + 1]
            h[: k + 1, k], m = v[: k + 1], k + 1
            g = np.zeros(m + 1)
            g[0] = beta
            y, *_ = np.linalg.lstsq(h[: m + 1, :m], g, rcond=None)
            error = float(np.linalg.norm(g - h[: m + 1, :m] @ y)) / norm
            stop = bool(monitor and monitor(used + m, error))
            if error < tol or stop or abs(h[m, k]) < 1e-14 * size:
                break
        used += m
        z = np.zeros(n)
        for k in range(m - 1, -1, -1):
            z[k] += y[k]
            z = _reflected(w[k], z)
        x = x + z


def cg(a: Operator, b: Vec, tol: float = 1e-8, max_iterations: int = 300, preconditioner=None, x0: Vec | None = None, monitor=None, abs_tol: float = 0.0, tables: bool = False) -> Result:
    """Conjugate gradients for symmetric positive definite matrices; tables=True takes the table form at any length.

    On tables, an iteration is one action, which writes the next state and observes both of its dot products. The test is
    on <r, M r> relative to its first value.
    """
    if driver_sized(b.n) and not tables:
        return _arrays(cg_arrays, a, b, x0, preconditioner, tol=tol, most=max_iterations, monitor=monitor, abs_tol=abs_tol)
    return _shifted(_cg_tables, a, b, x0, tol=tol, most=max_iterations, pre=preconditioner, monitor=monitor, abs_tol=abs_tol)


def _cg_tables(a, b, tol, most, pre, monitor, abs_tol) -> Result:
    """The recurrence with one synchronisation: with u = M r and w = A u known, <r, u> and <w, u> give both coefficients,
    p and A p follow by the same recurrence, and the two products are observed while the next state is written."""
    own = pre or (lambda r: r)
    kept = Mat(dealt(a.df, "j"), a.m, a.n) if isinstance(a, Mat) else a
    state = Written(b.df.sparkSession)

    def written(moved: DataFrame) -> tuple[float, float]:
        u = own(_column(moved, "r"))
        full = _with(_with(moved, u, "u"), apply(kept, u, b.n), "w")
        got = state.step(full, ru=_sum(F.col("r") * F.col("u")), wu=_sum(F.col("w") * F.col("u")))
        return got["ru"], got["wu"]

    ru, wu = written(_start(b).select("*", F.lit(0.0).alias("p"), F.lit(0.0).alias("s")))
    first, alpha, beta, k = ru, 1.0, 0.0, 0
    while k < most and ru != 0 and abs(ru) > abs_tol**2 and abs(ru) >= tol * tol * abs(first):
        alpha = ru / (wu - beta * ru / alpha)
        p, s = F.col("u") + beta * F.col("p"), F.col("w") + beta * F.col("s")
        moved = state.df.select("i", (F.col("x") + alpha * p).alias("x"), (F.col("r") - alpha * s).alias("r"), p.alias("p"), s.alias("s"))
        new, wu = written(moved)
        beta, ru, k = new / ru, new, k + 1
        if monitor and monitor(k, abs(ru / first) ** 0.5):
            break
    if kept is not a:
        kept.df.unpersist()
    return Result(Vec(_column(state.df, "x"), b.n), k, abs(ru / first) ** 0.5 if first else 0.0)


def cg_mixed(a: Mat, b: Vec, tol: float = 1e-8, max_iterations: int = 300, inner_tol: float = 1e-2) -> Result:
    """Conjugate gradients in single precision, restarted on the residual in double precision."""
    if driver_sized(b.n):
        return _arrays(mixed_arrays, a, b, None, None, tol=tol, most=max_iterations, inner_tol=inner_tol)
    single = Mat(a.df.withColumn("v", F.col("v").cast("float")), a.m, a.n)
    product = lambda x: gemv(single, Vec(x.withColumn("v", F.col("v").cast("float")), b.n)).df
    norm_b = b.df.agg(F.sqrt(_sum(F.col("v") ** 2))).first()[0]
    x, used, error = b.df.withColumn("v", F.lit(0.0)), 0, 1.0
    rest = b.df
    while norm_b and error > tol and used < max_iterations:
        step = cg(product, Vec(rest, b.n), inner_tol, max_iterations - used)
        used += max(1, step.iterations)
        x = checkpoint(_with(x.withColumnRenamed("v", "x"), step.x.df, "d", b.n).select("i", (F.col("x") + F.col("d")).alias("v")))
        rest = _with(b.df.withColumnRenamed("v", "b"), gemv(a, Vec(x, b.n)).df, "ax", b.n).select("i", (F.col("b") - F.col("ax")).alias("v"))
        rest = checkpoint(rest)
        error = rest.agg(F.sqrt(_sum(F.col("v") ** 2))).first()[0] / norm_b
    return Result(Vec(x, b.n), used, error if norm_b else 0.0)


def mixed_arrays(times, b, pre, tol, most, inner_tol):
    norm = float(np.linalg.norm(b))
    x, rest, used, error = np.zeros_like(b), b, 0, 1.0
    while norm and error > tol and used < most:
        d, k, _ = cg_arrays(times, rest.astype(np.float32), None, inner_tol, most - used, None, 0.0)
        used += max(1, k)
        x = x + d
        rest = b - times(x)
        error = float(np.linalg.norm(rest)) / norm
    return x, used, error if norm else 0.0


def bicgstab(a: Operator, b: Vec, tol: float = 1e-8, max_iterations: int = 400, preconditioner=None, x0: Vec | None = None, monitor=None, restart: int = 200, tables: bool = False) -> Result:
    """Stabilised bi-conjugate gradients; the test is the residual norm over that of b."""
    if driver_sized(b.n) and not tables:
        return _arrays(bicgstab_arrays, a, b, x0, preconditioner, tol=tol, most=max_iterations, monitor=monitor, restart=restart)
    return _shifted(_bicgstab, a, b, x0, tol=tol, most=max_iterations, pre=preconditioner or (lambda r: r), monitor=monitor, restart=restart)


def _bicgstab(a, b, tol, most, pre, monitor, restart) -> Result:
    """Two actions an iteration, one for each product: the second also observes what the residual's norm and the next
    coefficient follow from."""
    pre = pre or (lambda r: r)
    kept = Mat(dealt(a.df, "j"), a.m, a.n) if isinstance(a, Mat) else a
    state = Written(b.df.sparkSession)
    moved = _start(b).select("*", F.col("r").alias("s0"), F.col("r").alias("p"))
    norm, rho, error, k = None, None, 1.0, 0
    for k in range(1, most + 1):
        ph = pre(_column(moved, "p"))
        got = state.step(_with(_with(moved, ph, "ph"), apply(kept, ph, b.n), "ap"), s0ap=_sum(F.col("s0") * F.col("ap")), rr=_sum(F.col("r") ** 2))
        if norm is None:
            norm = rho = got["rr"]
            if norm == 0:
                return Result(Vec(_column(state.df, "x"), b.n), 0, 0.0)
        alpha = rho / got["s0ap"]
        half = state.df.withColumn("s", F.col("r") - alpha * F.col("ap"))
        sh = pre(_column(half, "s"))
        c = {n: F.col(n) for n in ("s", "as", "s0")}
        got = state.step(_with(_with(half, sh, "sh"), apply(kept, sh, b.n), "as"), ts=_sum(c["as"] * c["s"]), tt=_sum(c["as"] ** 2), ss=_sum(c["s"] ** 2), s0s=_sum(c["s0"] * c["s"]), s0t=_sum(c["s0"] * c["as"]))
        omega = got["ts"] / got["tt"] if got["tt"] else 0.0
        new, rr = got["s0s"] - omega * got["s0t"], max(0.0, got["ss"] - 2 * omega * got["ts"] + omega**2 * got["tt"])
        error = (rr / norm) ** 0.5
        x = F.col("x") + alpha * F.col("ph") + omega * F.col("sh")
        r = F.col("s") - omega * F.col("as")
        if (monitor and monitor(k, error)) or error < tol or omega == 0:
            break
        if k % restart == 0 or abs(new) < 1e-30 * norm:
            moved, rho = state.df.select("i", x.alias("x"), r.alias("r"), r.alias("s0"), r.alias("p")), rr
        else:
            beta = (new / rho) * (alpha / omega)
            moved, rho = state.df.select("i", x.alias("x"), r.alias("r"), "s0", (r + beta * (F.col("p") - omega * F.col("ap"))).alias("p")), new
    if kept is not a:
        kept.df.unpersist()
    return Result(Vec(state.df.select("i", x.alias("v")), b.n), k, error)


def gmres(a: Operator, b: Vec, tol: float = 1e-10, max_iterations: int = 300, krylov: int = 20, preconditioner=None, x0: Vec | None = None, monitor=None, reflections: bool = False) -> Result:
    """Restarted GMRES, left-preconditioned. The basis is one table (i, q0, q1, ...); orthogonalisation against all
    of it is one aggregate, done twice for stability; the small least-squares problem is solved on the driver. With
    reflections the basis is made of them, where vectors fit the driver."""
    if driver_sized(b.n):
        return _arrays(gmres_reflector_arrays if reflections else gmres_arrays, a, b, x0, preconditioner, tol=tol, most=max_iterations, monitor=monitor, krylov=krylov)
    if reflections:
        raise ValueError("reflections need vectors that fit the driver")
    return _shifted(_gmres, a, b, x0, tol=tol, most=max_iterations, krylov=krylov, pre=preconditioner or (lambda r: r), monitor=monitor)


def _gmres(a, b, tol, most, krylov, pre, monitor) -> Result:
    x, used, norm_b, error = b.df.withColumn("v", F.lit(0.0)), 0, None, 1.0
    while True:
        rest = _with(b.df.withColumnRenamed("v", "b"), apply(a, x, b.n), "ax", b.n).select("i", (F.col("b") - F.col("ax")).alias("v")) if used else b.df
        base = State(_with(b.df.select("i"), pre(rest), "q", b.n), b.n)
        beta = base.df.agg(F.sqrt(_sum(F.col("q") ** 2))).first()[0]
        norm_b = beta if norm_b is None else norm_b
        if norm_b == 0:
            return Result(Vec(x, b.n), 0, 0.0)
        error = beta / norm_b
        if error < tol or used >= most:
            return Result(Vec(x, b.n), used, error)
        basis = State(base.df.select("i", (F.col("q") / beta).alias("q0")), b.n)
        h, m, stop = np.zeros((krylov + 1, krylov)), 0, False
        for k in range(min(krylov, most - used)):
            w = State(_with(basis.df, pre(apply(a, _column(basis.df, f"q{k}"), b.n)), "w", b.n), b.n)
            for _ in range(2):
                c = list(w.df.agg(*[_sum(F.col(f"q{j}") * F.col("w")) for j in range(k + 1)]).first())
                h[: k + 1, k] += c
                less = F.col("w")
                for j, cj in enumerate(c):
                    less = less - cj * F.col(f"q{j}")
                w.near(w.df.withColumn("w", less))
            h[k + 1, k] = w.df.agg(F.sqrt(_sum(F.col("w") ** 2))).first()[0]
            w.settle()
            m = k + 1
            g = np.zeros(m + 1)
            g[0] = beta
            y, *_ = np.linalg.lstsq(h[: m + 1, :m], g, rcond=None)
            error = float(np.linalg.norm(g - h[: m + 1, :m] @ y)) / norm_b
            stop = bool(monitor and monitor(used + m, error))
            if error < tol or stop or h[k + 1, k] < 1e-14 * beta:
                break
            basis.step(w.df.withColumn(f"q{k + 1}", F.col("w") / h[k + 1, k]).drop("w"))
            basis.settle()
            w.df.unpersist()
        used += m
        add = F.lit(0.0)
        for j, yj in enumerate(y):
            add = add + float(yj) * F.col(f"q{j}")
        x = checkpoint(_with(x.withColumnRenamed("v", "x"), basis.df.select("i", add.alias("v")), "d", b.n).select("i", (F.col("x") + F.col("d")).alias("v")))
        base.df.unpersist()
        basis.df.unpersist()
        if stop:
            return Result(Vec(x, b.n), used, error)
