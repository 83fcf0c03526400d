"""Preconditioners: objects that map a residual DataFrame (i, v) to a corrected one, and arrays likewise (blocks.Both).

Incomplete factorizations are sequential by nature, so they run on diagonal blocks, one grouped call each (one block
is the classical form and must fit one task; a block may have types.LOCAL_ENTRIES entries at most). The Chow-Patel
forms and the approximate inverses work on all entries at once by joins or for each column alone.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axolin.operators.matrix import row_info
from axolin.operators.product import gemv
from axolin.plans.blocks import BlockMaps, Both, packed, to_array
from axolin.plans.loop import ONE_PARTITION, checkpoint
from axolin.types import LOCAL_ENTRIES, Mat, Vec, need


def jacobi(a: Mat):
    """Division by the diagonal; a missing or zero diagonal entry raises."""
    return _divide(a, "diag")


def row_scaling(a: Mat, p: int = 2):
    """Division by the rows' norms: 0 for the largest magnitude, 1 or 2; a zero row raises."""
    need(p in (0, 1, 2), "the norm is 0, 1 or 2")
    return _divide(a, {0: "norm_inf", 1: "norm_1", 2: "norm_2"}[p])


def _divide(a: Mat, what: str):
    d = checkpoint(row_info(a).select("i", F.col(what).alias("d")))
    if d.where("d = 0").limit(1).count():
        raise ZeroDivisionError(f"a row has no {what}")

    def arrays():
        diagonal = to_array(d.withColumnRenamed("d", "v"), a.m)
        return lambda r: r / diagonal

    return Both(a.m, lambda r: r.join(d, "i").select("i", (F.col("v") / F.col("d")).alias("v")), arrays)


def _rows_of(t: pd.DataFrame, at: int, n: int) -> list[dict[int, float]]:
    rows: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, v in zip(t["i"].to_numpy(int) - at, t["j"].to_numpy(int) - at, t["v"], strict=True):
        rows[i][int(j)] = float(v)
    return rows


def factor_ilu0(rows: list[dict[int, float]]) -> list[dict[int, float]]:
    """L (unit, below) and U in the pattern of A."""
    for i, row in enumerate(rows):
        for k in sorted(c for c in row if c < i):
            pivot = rows[k].get(k, 0.0)
            if pivot == 0:
                raise ZeroDivisionError(f"zero pivot in row {k}")
            f = row[k] = row[k] / pivot
            for c, u in rows[k].items():
                if c > k and c in row:
                    row[c] -= f * u
    return rows


def factor_ilut(rows: list[dict[int, float]], entries: int = 20, drop: float = 1e-4) -> list[dict[int, float]]:
    """Entries under drop times the row's 2-norm go; of each half of a row the `entries` largest and the diagonal stay."""
    done: list[dict[int, float]] = []
    for i, row in enumerate(rows):
        limit, w = drop * sum(v * v for v in row.values()) ** 0.5, dict(row)
        open_ = sorted(c for c in w if c < i)
        while open_:
            k = open_.pop(0)
            f = w[k] / done[k][k]
            if abs(f) <= limit:
                del w[k]
                continue
            w[k] = f
            for c, u in done[k].items():
                if c > k:
                    if c not in w and c < i:
                        open_ = sorted([*open_, c])
                    w[c] = w.get(c, 0.0) - f * u
        big = lambda part: dict(sorted(((c, v) for c, v in part if abs(v) > limit), key=lambda x: (-abs(x[1]), x[0]))[:entries])
        if w.get(i, 0.0) == 0:
            raise ZeroDivisionError(f"zero pivot in row {i}")
        done.append({**big((c, v) for c, v in w.items() if c < i), i: w[i], **big((c, v) for c, v in w.items() if c > i)})
    return done


def factor_ichol0(rows: list[dict[int, float]]) -> list[dict[int, float]]:
    """L of L L^T in the pattern of A's lower triangle; returned with L^T above, so that it solves like an LU."""
    low: list[dict[int, float]] = []
    for i, row in enumerate(rows):
        mine: dict[int, float] = {}
        for k in sorted(c for c in row if c <= i):
            s = row[k] - sum(v * low[k][c] for c, v in mine.items() if k < i and c < k and c in low[k])
            if k < i:
                mine[k] = s / low[k][k]
            else:
                s = row[k] - sum(v * v for v in mine.values())
                if s <= 0:
                    raise ZeroDivisionError(f"no positive pivot in row {i}")
                mine[k] = s**0.5
        low.append(mine)
    # L L^T = (L D^-1)(D L^T) with D the diagonal of L
    out: list[dict[int, float]] = [{} for _ in rows]
    for i, mine in enumerate(low):
        for k, v in mine.items():
            if k < i:
                out[i][k] = v / low[k][k]
            out[k][i] = v * low[k][k]
    return out


def solve_lu(rows: list[dict[int, float]], r: np.ndarray) -> np.ndarray:
    y = r.copy()
    for i, row in enumerate(rows):
        y[i] -= sum(v * y[c] for c, v in row.items() if c < i)
    for i in range(len(rows) - 1, -1, -1):
        y[i] = (y[i] - sum(v * y[c] for c, v in rows[i].items() if c > i)) / rows[i][i]
    return y


class Levels:
    """Solves with a triangle, given by rows: rows that depend on no row of their own level are solved together."""

    def __init__(self, rows: list[dict[int, float]], lower: bool):
        n = len(rows)
        level, by_level = np.zeros(n, int), {}
        for i in range(n) if lower else range(n - 1, -1, -1):
            level[i] = 1 + max((level[c] for c in rows[i] if (c < i if lower else c > i)), default=-1)
            by_level.setdefault(int(level[i]), []).append(i)
        self.steps = []
        for k in sorted(by_level):
            cells = [(p, c, v) for p, i in enumerate(by_level[k]) for c, v in rows[i].items() if (c < i if lower else c > i)]
            at, cols, vals = (np.array(x, t) for x, t in zip(zip(*cells, strict=True), (np.int64, np.int64, float), strict=True)) if cells else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            self.steps.append((np.array(by_level[k]), at, cols, vals, np.array([1.0 if lower else rows[i][i] for i in by_level[k]])))

    def __call__(self, y: np.ndarray) -> np.ndarray:
        y = y.copy()
        for rows, at, cols, vals, diagonal in self.steps:
            y[rows] = (y[rows] - np.bincount(at, vals * y[cols], len(rows))) / diagonal
        return y


class FactorSolver:
    """x with L U x = r for incomplete factors of a block."""

    def __init__(self, rows: list[dict[int, float]]):
        self.low, self.up = Levels(rows, True), Levels(rows, False)

    def __call__(self, r: np.ndarray) -> np.ndarray:
        return self.up(self.low(r))


FACTORS = {"ilu0": factor_ilu0, "ilut": factor_ilut, "ichol0": factor_ichol0}


def block_bounds(n: int, blocks: int) -> list[int]:
    return [n * k // blocks for k in range(blocks + 1)]


#: Rows of a block where the number of blocks is left open.
BLOCK_ROWS = 50_000


def factorize(a: Mat, kind: str = "ilu0", blocks: int | None = None, **options) -> DataFrame:
    """(b, i, j, v): the incomplete factors of the diagonal blocks, with indices of the whole matrix."""
    blocks = blocks or max(1, -(-a.m // BLOCK_ROWS))
    need(a.m == a.n and kind in FACTORS, "a square matrix and a known kind are needed")
    bounds = block_bounds(a.m, blocks)
    number = _block_number(bounds)
    inside = a.df.withColumn("b", number("i")).where(F.col("b") == number("j"))
    most = inside.groupBy("b").count().agg(F.max("count")).first()[0] or 0
    need(most <= LOCAL_ENTRIES, f"a block has {most} entries; use more blocks")

    def run(key, t: pd.DataFrame) -> pd.DataFrame:
        b = int(key[0])
        at, n = bounds[b], bounds[b + 1] - bounds[b]
        rows = FACTORS[kind](_rows_of(t, at, n), **options)
        cells = [(b, i + at, j + at, v) for i, row in enumerate(rows) for j, v in row.items()]
        return pd.DataFrame(cells, columns=["b", "i", "j", "v"])

    return inside.groupBy("b").applyInPandas(run, "b int, i long, j long, v double")


def _block_number(bounds: list[int]):
    n, blocks = bounds[-1], len(bounds) - 1
    return lambda i: F.expr(f"CAST((({i} + 1) * {blocks} - 1) div {max(1, n)} AS INT)")


def incomplete(a: Mat, kind: str = "ilu0", blocks: int | None = None, **options):
    """A preconditioner from incomplete factors of the diagonal blocks; one block for each BLOCK_ROWS rows by default."""
    blocks = blocks or max(1, -(-a.m // BLOCK_ROWS))
    bounds = block_bounds(a.m, blocks)
    factors = checkpoint(factorize(a, kind, blocks, **options))
    number = _block_number(bounds)

    def solve(key, t: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        b = int(key[0])
        at, n = bounds[b], bounds[b + 1] - bounds[b]
        y = np.zeros(n)
        y[r["i"].to_numpy(int) - at] = r["v"]
        return pd.DataFrame({"i": np.arange(at, at + n), "v": solve_lu(_rows_of(t, at, n), y)})

    def whole(key, t: pd.DataFrame) -> pd.DataFrame:
        b = int(key[0])
        at, stop = bounds[b], bounds[b + 1]
        return pd.DataFrame({"key": [b], "start": [at], "stop": [stop], "data": [pickle.dumps(FactorSolver(_rows_of(t, at, stop - at)))]})

    def arrays():
        return BlockMaps(factors.groupBy("b").applyInPandas(whole, "key int, start long, stop long, data binary"), uuid.uuid4().hex)

    frames = lambda r: factors.groupBy("b").cogroup(r.groupBy(number("i").alias("b"))).applyInPandas(solve, "i long, v double").transform(checkpoint)
    return Both(a.m, frames, arrays)


def scaled(a: Mat) -> DataFrame:
    """D A D with D = 1 / sqrt of the diagonal's magnitude."""
    d = a.df.where(F.col("i") == F.col("j")).select(F.col("i").alias("k"), (1 / F.sqrt(F.abs(F.col("v")))).alias("d"))
    e = d.select(F.col("k").alias("l"), F.col("d").alias("e"))
    return a.df.join(d, F.col("i") == F.col("k")).join(e, F.col("j") == F.col("l")).select("i", "j", (F.col("v") * F.col("d") * F.col("e")).alias("v"))


def chow_patel_icc(a: Mat, sweeps: int = 3) -> DataFrame:
    """L of D A D by synchronous fixed-point sweeps: every entry from the values of the sweep before."""
    target = checkpoint(scaled(a).where(F.col("j") <= F.col("i")))
    low = target
    for _ in range(sweeps):
        x, y = low.select("i", F.col("j").alias("k"), F.col("v").alias("p")), low.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("q"))
        sums = x.join(y, "k").where((F.col("k") < F.col("j")) & (F.col("j") <= F.col("i"))).groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("s"))
        diag = low.where(F.col("i") == F.col("j")).select(F.col("j").alias("dj"), F.col("v").alias("d"))
        rest = target.join(sums, ["i", "j"], "left").withColumn("t", F.col("v") - F.coalesce("s", F.lit(0.0))).join(diag, F.col("j") == F.col("dj"))
        low = checkpoint(rest.select("i", "j", F.when(F.col("i") == F.col("j"), F.sqrt("t")).otherwise(F.col("t") / F.col("d")).alias("v")))
    return low


def chow_patel_ilu(a: Mat, sweeps: int = 3) -> tuple[DataFrame, DataFrame]:
    """(L with a unit diagonal, U) of D A D by synchronous sweeps."""
    target = checkpoint(scaled(a))
    low = target.where(F.col("j") < F.col("i"))
    up = target.where(F.col("j") >= F.col("i"))
    for _ in range(sweeps):
        x, y = low.select("i", F.col("j").alias("k"), F.col("v").alias("p")), up.select(F.col("i").alias("k"), "j", F.col("v").alias("q"))
        sums = x.join(y, "k").where(F.col("k") < F.least(F.col("i"), F.col("j"))).groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("s"))
        diag = up.where(F.col("i") == F.col("j")).select(F.col("j").alias("dj"), F.col("v").alias("d"))
        rest = target.join(sums, ["i", "j"], "left").withColumn("t", F.col("v") - F.coalesce("s", F.lit(0.0))).join(diag, F.col("j") == F.col("dj"))
        new = checkpoint(rest.select("i", "j", F.when(F.col("j") < F.col("i"), F.col("t") / F.col("d")).otherwise(F.col("t")).alias("v")))
        low, up = new.where(F.col("j") < F.col("i")), new.where(F.col("j") >= F.col("i"))
    unit = a.df.sparkSession.range(a.m).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    return low.unionByName(unit), up


def neumann(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(M, diagonal as (i, d)): every off-diagonal entry over minus its row's diagonal."""
    d = t.where(F.col("i") == F.col("j")).select("i", F.col("v").alias("d"))
    return t.where(F.col("i") != F.col("j")).join(d, "i").select("i", "j", (-F.col("v") / F.col("d")).alias("v")), d


def jacobi_solve(t: DataFrame, n: int, iterations: int = 2):
    """An approximate triangular solve: y = M y + x / diagonal, a few times."""
    m, d = map(checkpoint, neumann(t))

    def run(x: DataFrame) -> DataFrame:
        b = x.join(d, "i").select("i", (F.col("v") / F.col("d")).alias("v"))
        y = b
        for _ in range(iterations):
            y = b.unionByName(gemv(Mat(m, n, n), Vec(y, n)).df).groupBy("i").agg(F.sum("v").alias("v"))
        return checkpoint(y.coalesce(1) if n <= ONE_PARTITION else y)

    def arrays():
        part, diagonal = packed(Mat(m, n, n)), to_array(d.withColumnRenamed("d", "v"), n)

        def solve(x: np.ndarray) -> np.ndarray:
            b = x / diagonal
            y = b
            for _ in range(iterations):
                y = b + part.times(y)
            return y

        return solve

    return Both(n, run, arrays)


def chow_patel(a: Mat, symmetric: bool = False, sweeps: int = 3, iterations: int = 2):
    """Chow-Patel ILU, or ICC for symmetric matrices, applied by Jacobi iterations. The factors are those of D A D."""
    if symmetric:
        low = chow_patel_icc(a, sweeps)
        up = Mat(low, a.m, a.n).T.df
    else:
        low, up = chow_patel_ilu(a, sweeps)
    first, second = jacobi_solve(low, a.m, iterations), jacobi_solve(up, a.m, iterations)
    return Both(a.m, lambda r: second(first(r)), lambda: lambda r: second.arrays(first.arrays(r)))


def spai(a: Mat, rounds: int = 5, tol: float = 1e-3, static: bool = False) -> Mat:
    """A sparse approximate inverse M, |A m_k - e_k| least over a pattern for every column k alone.

    The pattern starts as A's column and grows for columns whose residual is over tol, by the columns that meet the
    residual's rows, for at most `rounds` rounds. Each round is joins for the pattern and grouped least squares.
    """
    need(a.m == a.n, "a square matrix is needed")
    pattern = a.df.select(F.col("j").alias("k"), F.col("i").alias("c")).distinct()
    done = None
    for turn in range(1 if static else rounds):
        cells = pattern.join(a.df.select("i", F.col("j").alias("c"), "v"), "c")

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            k = int(pdf["k"].iloc[0])
            rows, cols = np.unique(np.append(pdf["i"], k)), np.unique(pdf["c"])
            m = np.zeros((len(rows), len(cols)))
            m[np.searchsorted(rows, pdf["i"]), np.searchsorted(cols, pdf["c"])] = pdf["v"]
            e = (rows == k).astype(float)
            y, *_ = np.linalg.lstsq(m, e, rcond=None)
            rest = e - m @ y
            bad = np.linalg.norm(rest) > tol
            grow = rows[np.abs(rest) > 1e-12] if bad else rows[:0]
            return pd.DataFrame({"k": k, "c": np.append(cols, grow), "v": np.append(y, np.zeros(len(grow))), "grow": np.append(np.zeros(len(cols), bool), np.ones(len(grow), bool)), "open": bad})

        got = checkpoint(cells.groupBy("k").applyInPandas(fit, "k long, c long, v double, grow boolean, open boolean"))
        last = static or turn == rounds - 1
        closed = got.where("not grow" if last else "not open and not grow").select(F.col("c").alias("i"), F.col("k").alias("j"), "v")
        done = closed if done is None else done.unionByName(closed)
        open_ = got.where("open")
        if last or not open_.limit(1).count():
            break
        meets = open_.where("grow").select("k", F.col("c").alias("i")).join(a.df.select("i", F.col("j").alias("c")), "i").select("k", "c")
        pattern = checkpoint(open_.where("not grow").select("k", "c").unionByName(meets).distinct())
    return Mat(checkpoint(done), a.m, a.n)


def fspai(a: Mat) -> Mat:
    """L with L L^T close to A^-1 for symmetric positive definite A, each column k from A's pattern below k alone."""
    below = a.df.where(F.col("i") > F.col("j")).select(F.col("j").alias("k"), F.col("i").alias("c"))
    cells = below.unionByName(a.df.sparkSession.range(a.m).select(F.col("id").alias("k"), F.col("id").alias("c")))
    rows = cells.join(a.df.select(F.col("i").alias("c"), F.col("j").alias("l"), "v"), "c")
    both = rows.join(cells.select("k", F.col("c").alias("l")), ["k", "l"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["k"].iloc[0])
        idx = np.unique(pdf["c"])
        m = np.zeros((len(idx), len(idx)))
        m[np.searchsorted(idx, pdf["c"]), np.searchsorted(idx, pdf["l"])] = pdf["v"]
        own = idx == k
        y = np.linalg.solve(m[~own][:, ~own], m[~own][:, own][:, 0]) if (~own).any() else np.zeros(0)
        d = 1 / np.sqrt(m[own, own][0] - m[own][0][~own] @ y)
        out = np.zeros(len(idx))
        out[own], out[~own] = d, -d * y
        return pd.DataFrame({"i": idx, "j": k, "v": out})

    return Mat(both.groupBy("k").applyInPandas(fit, "i long, j long, v double"), a.m, a.n)


def inverse_of(m: Mat):
    """The preconditioner r -> M r."""
    return Both(m.n, lambda r: gemv(m, Vec(r, m.n)).df, lambda: packed(m).times)


def factored_inverse_of(low: Mat):
    """The preconditioner r -> L L^T r."""

    def arrays():
        part = packed(low)
        return lambda r: part.times(part.times_t(r))

    return Both(low.m, lambda r: gemv(low, gemv(low, Vec(r, low.m), transposed=True)).df, arrays)
