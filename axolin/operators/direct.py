"""Direct solvers and orthogonal factorizations.

Triangular solves go by dependency levels (operators.substitution), or by halves where right-hand sides exceed the
driver; the unpivoted LU runs over blocks of rows: a block of bounded size is solved on the driver or in grouped numpy
calls, and its effect on the rest is a distributed join and sum. QR reduces tall matrices up a tree of tasks and keeps its
reflectors (operators.reflectors).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axolin.operators.matrix import diagonal_block
from axolin.operators.product import multiply
from axolin.operators.reflectors import factor
from axolin.operators.substitution import in_blocks, on_driver, substitute
from axolin.plans.loop import checkpoint
from axolin.sources import to_numpy
from axolin.types import LOCAL_ENTRIES, Mat, Vec, need

BLOCK, PANEL = 128, 32
_COO = "i long, j long, v double"


def _block(a: DataFrame, start: int, stop: int) -> np.ndarray:
    """A diagonal block, at most BLOCK x BLOCK cells, on the driver."""
    return to_numpy(Mat(diagonal_block(a, start, stop), stop - start, stop - start))


def _for_columns(d: np.ndarray, start: int):
    """Solves d x = r for the group of one column's entries in the rows from start on."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros(len(d))
        r[pdf["i"].to_numpy(int) - start] = pdf["v"]
        return pd.DataFrame({"i": np.arange(start, start + len(d)), "j": int(pdf["j"].iloc[0]), "v": np.linalg.solve(d, r)})

    return solve


def _for_rows(d: np.ndarray, start: int):
    """Solves x d = r for the group of one row's entries in the columns from start on."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros(len(d))
        r[pdf["j"].to_numpy(int) - start] = pdf["v"]
        return pd.DataFrame({"i": int(pdf["i"].iloc[0]), "j": np.arange(start, start + len(d)), "v": np.linalg.solve(d.T, r)})

    return solve


def trsm(a: Mat, b: Mat, kind: str = "lower", unit: bool = False, transposed: bool = False, block: int = BLOCK, transposed_b: bool = False) -> Mat:
    """X with op(T) X = op(B), T the lower or upper triangle of A, with a unit diagonal if asked.

    Right-hand sides that fit the driver are solved by substitution along dependency levels. Beyond that the triangle is
    halved until a block of at most `block` rows is left, which is solved for all right-hand sides by
    grouped numpy calls. What the first half of a range gives to the second is one product of a square of T with the
    solved half, so every solved part is read once for each halving and not once for each later block, and no plan holds
    more than one half. A zero on the diagonal raises.
    """
    b = b.T if transposed_b else b
    need(kind in ("lower", "upper") and a.m == a.n == b.m, "a square triangle and a fitting right-hand side are needed")
    if on_driver(a.m, b.n):
        return substitute(a, b, kind, unit, transposed)
    tri = a.df.where(F.col("j") <= F.col("i")) if kind == "lower" else a.df.where(F.col("j") >= F.col("i"))
    if transposed:
        tri, kind = Mat(tri, a.m, a.n).T.df, "upper" if kind == "lower" else "lower"
    blocks = -(-a.m // block)
    if blocks == 0:
        return b
    number = lambda c: F.expr(f"{c} div {block}")
    # one job gathers the bounded diagonal blocks' zero test; each block itself is fetched when its turn comes
    if not unit:
        full = tri.where("i = j AND v != 0").count()
        if full != a.m:
            raise ZeroDivisionError("zero on the diagonal")

    def solve(lo: int, hi: int, rest: DataFrame) -> DataFrame:
        """The solution in the rows of blocks lo..hi-1 of what is left of the right-hand side there."""
        if hi - lo == 1:
            d = _block(tri, lo * block, min(a.m, hi * block))
            if unit:
                np.fill_diagonal(d, 1.0)
            return checkpoint(rest.groupBy("j").applyInPandas(_for_columns(d, lo * block), _COO))
        mid = (lo + hi) // 2
        inside = lambda c, x, y: (number(c) >= x) & (number(c) < y)
        first, second = ((lo, mid), (mid, hi)) if kind == "lower" else ((mid, hi), (lo, mid))
        x = solve(*first, rest.where(inside("i", *first)))
        known = x.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("v").alias("w"))
        square = tri.where(inside("i", *second) & inside("j", *first))
        less = square.join(known, F.col("j") == F.col("k")).select("i", F.col("c").alias("j"), (-F.col("v") * F.col("w")).alias("v"))
        left = checkpoint(rest.where(inside("i", *second)).unionByName(less).groupBy("i", "j").agg(F.sum("v").alias("v")))
        return checkpoint(x.unionByName(solve(*second, left)))

    return Mat(solve(0, blocks, b.df), b.m, b.n)


def trsv(a: Mat, b: Vec, kind: str = "lower", unit: bool = False, transposed: bool = False, block: int = BLOCK) -> Vec:
    x = trsm(a, Mat(b.df.select("i", F.lit(0).cast("bigint").alias("j"), "v"), b.n, 1), kind, unit, transposed, block)
    return Vec(x.df.select("i", "v"), b.n)


def block_trsv(a: Mat, b: Vec, blocks: int, kind: str = "lower", unit: bool = False) -> Vec:
    """Independent triangular solves with the diagonal blocks of A, their levels side by side."""
    return trsv(in_blocks(a, blocks), b, kind, unit)


def lu(a: Mat, panel: int = PANEL) -> Mat:
    """L and U without pivoting in one matrix (L has a unit diagonal); a zero pivot raises."""
    need(a.m == a.n, "a square matrix is needed")
    rest, out = a.df, None
    for start in range(0, a.m, panel):
        stop = min(a.m, start + panel)
        d = _block(rest, start, stop)
        for k in range(len(d)):
            if d[k, k] == 0:
                raise ZeroDivisionError(f"zero pivot in row {start + k}")
            d[k + 1 :, k] /= d[k, k]
            d[k + 1 :, k + 1 :] -= np.outer(d[k + 1 :, k], d[k, k + 1 :])
        low, up = np.tril(d, -1) + np.eye(len(d)), np.triu(d)

        i, j = np.indices(d.shape)
        own = a.df.sparkSession.createDataFrame(pd.DataFrame({"i": i.ravel() + start, "j": j.ravel() + start, "v": d.ravel()}), _COO)
        part = own
        if stop < a.m:
            l21 = rest.where((F.col("i") >= stop) & (F.col("j") >= start) & (F.col("j") < stop)).groupBy("i").applyInPandas(_for_rows(up, start), _COO)
            u12 = rest.where((F.col("j") >= stop) & (F.col("i") >= start) & (F.col("i") < stop)).groupBy("j").applyInPandas(_for_columns(low, start), _COO)
            part = checkpoint(own.unionByName(l21).unionByName(u12))
            update = multiply(Mat(part.where(F.col("i") >= stop), a.m, a.n), Mat(part.where(F.col("j") >= stop), a.m, a.n)).df
            rest = checkpoint(rest.where((F.col("i") >= stop) & (F.col("j") >= stop)).unionByName(update.withColumn("v", -F.col("v"))).groupBy("i", "j").agg(F.sum("v").alias("v")))
        out = part if out is None else out.unionByName(part)
    return Mat(out if out is not None else a.df, a.m, a.n)


def lu_solve(factors: Mat, b: Vec) -> Vec:
    return trsv(factors, trsv(factors, b, "lower", unit=True), "upper")


def _rows(a: Mat) -> DataFrame:
    return a.df.groupBy("i").agg(F.collect_list(F.col("j").cast("bigint")).alias("js"), F.collect_list(F.col("v").cast("double")).alias("vs"))


def _dense(b: pa.RecordBatch, n: int) -> np.ndarray:
    """The rows of a batch (i, js, vs)."""
    js, vs = b.column("js"), b.column("vs")
    x = np.zeros((b.num_rows, n))
    at = np.repeat(np.arange(b.num_rows), js.value_lengths().to_numpy(zero_copy_only=False))
    x[at, js.flatten().to_numpy(zero_copy_only=False)] = vs.flatten().to_numpy(zero_copy_only=False)
    return x


def qr_r(a: Mat, fan: int = 8) -> np.ndarray:
    """R with a non-negative diagonal (n x n, on the driver), for at most sqrt(LOCAL_ENTRIES) columns: every partition
    reduces its rows to n, and `fan` partial factors at a time are reduced again up a tree of tasks until one is left.
    Levels are parted by a shuffle of the factors, so that the first one keeps all its tasks."""
    n = a.n
    need(n * n <= LOCAL_ENTRIES, "too many columns")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, n))
        for b in batches:
            r = np.linalg.qr(np.vstack([r, _dense(b, n)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.vstack([np.frombuffer(x).reshape(-1, n) for x in pdf["r"]]), mode="r")
        return pd.DataFrame({"part": [int(key[0])], "r": [r.tobytes()]})

    parts = checkpoint(_rows(a).mapInArrow(first, "part int, r binary"))
    while parts.count() > fan:
        parts = checkpoint(parts.groupBy(F.expr(f"part div {fan}").cast("int").alias("part")).applyInPandas(merge, "part int, r binary"))
    rows = [np.frombuffer(x.r).reshape(-1, n) for x in parts.orderBy("part").collect()]
    r = np.linalg.qr(np.vstack(rows), mode="r") if rows else np.zeros((0, n))
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] if len(r) == n else r


def times_rows(a: Mat, m: np.ndarray) -> Mat:
    """A M for a dense M of few columns, row by row."""
    n, k = a.n, m.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _dense(b, n) @ m
            i = b.column("i").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, k)), pa.array(np.tile(np.arange(k), len(i))), pa.array(q.ravel())], ["i", "j", "v"])

    return Mat(_rows(a).mapInArrow(run, _COO), a.m, k)


def qr(a: Mat) -> tuple[Mat, np.ndarray]:
    """(Q, R): the columns of Q are orthonormal whatever A's rank; R has a non-negative diagonal."""
    f = factor(a)
    return f.q(), f.r


def least_squares(a: Mat, b: Vec) -> Vec:
    """x of least |A x - b|, the shortest one where A's columns depend on each other: R x = Q^T b."""
    f = factor(a)
    c = f.transposed_times(Mat(b.df.select("i", F.lit(0).cast("bigint").alias("j"), "v"), b.n, 1))[:, 0]
    x = np.linalg.lstsq(f.r, c, rcond=None)[0]
    return Vec(a.df.sparkSession.createDataFrame(pd.DataFrame({"i": np.arange(a.n), "v": x}), "i long, v double"), a.n)
