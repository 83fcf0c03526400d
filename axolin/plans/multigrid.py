"""Algebraic multigrid: coarsening, interpolation and the V-cycle.

Neighbourhoods, interpolation and coarse matrices are joins. Independent sets are found in parallel rounds with hashed
weights. Of the two sequential coarsenings the aggregation goes by rounds beyond types.LOCAL_ENTRIES entries, with the same
result; the one-pass coarsening is refused there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axolin.operators.product import galerkin, gemv, multiply
from axolin.operators.vector import axpby
from axolin.plans.blocks import packed, to_array, to_table
from axolin.plans.loop import checkpoint
from axolin.sources import to_numpy
from axolin.types import LOCAL_ENTRIES, Mat, Vec, driver_sized, need

UNDECIDED, COARSE, FINE = 0, 1, 2


def influence(a: Mat, threshold: float | None = None) -> DataFrame:
    """(i, j): j influences i. All off-diagonal entries, or with a threshold the strong ones by sign of the diagonal."""
    off = a.df.where(F.col("i") != F.col("j"))
    if threshold is None:
        return off.select("i", "j")
    ends = a.df.groupBy("i").agg(F.min(F.when(F.col("i") != F.col("j"), F.col("v"))).alias("lo"), F.max(F.when(F.col("i") != F.col("j"), F.col("v"))).alias("hi"), F.max(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("d"))
    strong = F.when(F.col("d") > 0, F.col("d") * F.col("v") <= threshold * F.col("d") * F.col("lo")).when(F.col("d") < 0, F.col("d") * F.col("v") <= threshold * F.col("d") * F.col("hi"))
    return off.join(ends, "i").where(strong).select("i", "j")


def _gathered(edges: DataFrame) -> pd.DataFrame:
    n = edges.count()
    need(n <= LOCAL_ENTRIES, f"{n} entries are too many for a sequential coarsening; use independent sets")
    return edges.orderBy("i", "j").toPandas()


def coarsen_onepass(a: Mat, threshold: float = 0.1) -> DataFrame:
    """(i, state): repeatedly the undecided node that influences most nodes becomes coarse, those it influences fine."""
    e = _gathered(influence(a, threshold))
    by, on = [[] for _ in range(a.m)], [[] for _ in range(a.m)]
    for i, j in zip(e["i"].tolist(), e["j"].tolist(), strict=True):
        on[i].append(j)
        by[j].append(i)
    state, score = np.zeros(a.m, int), np.array([len(x) for x in by])
    buckets: dict[int, set[int]] = {}
    for k, s in enumerate(score.tolist()):
        buckets.setdefault(s, set()).add(k)
    top = max(buckets, default=-1)
    while top >= 0:
        if not buckets.get(top):
            top -= 1
            continue
        k = max(buckets[top])
        buckets[top].remove(k)
        if state[k]:
            continue
        state[k] = COARSE
        for f in by[k]:
            if state[f] == UNDECIDED:
                state[f] = FINE
                for u in on[f]:
                    if state[u] == UNDECIDED:
                        buckets[score[u]].discard(u)
                        score[u] += 1
                        buckets.setdefault(int(score[u]), set()).add(u)
                        top = max(top, int(score[u]))
    return a.df.sparkSession.createDataFrame(pd.DataFrame({"i": np.arange(a.m), "state": state}), "i long, state int")


_OPEN = np.iinfo(np.int32).max


def _least_next(rows, at, cols, vals, value):
    return rows, np.minimum.reduceat(value[cols], at)


def _aggregate_rounds(edges: DataFrame, n: int, symmetric: bool) -> np.ndarray:
    """The roots of the sequential aggregation: a candidate becomes a root when no smaller one takes it, has it as a
    neighbour or takes a neighbour of it. Every round has the least candidate, and all others that wait for none."""
    need(driver_sized(n), "the nodes must fit the driver")
    edges = edges.withColumn("v", F.lit(1.0))
    near = packed(Mat(edges, n, n), pattern=True)
    by = near if symmetric else packed(Mat(edges, n, n).T, pattern=True)
    index, root, candidate = np.arange(n, dtype=np.int32), np.full(n, -1), np.ones(n, bool)

    def least(part, value: np.ndarray) -> np.ndarray:
        out = np.full(n, _OPEN, np.int32)
        for rows, v in part.each(_least_next, value):
            out[rows] = np.minimum(out[rows], v)
        return out

    while candidate.any():
        value = np.where(candidate, index, _OPEN)
        taker = np.minimum(value, least(by, value))  # of every node the least candidate that would take it
        new = candidate & (np.minimum(taker, least(near, taker)) == index)
        taken = np.flatnonzero((taker < _OPEN) & new[np.minimum(taker, n - 1)])
        root[taken] = taker[taken]
        candidate &= (root < 0) & (least(near, np.where(root >= 0, index, _OPEN)) == _OPEN)
    first = least(near, np.where(root >= 0, index, _OPEN))
    rest = np.flatnonzero(root < 0)
    root[rest] = root[first[rest]]
    for part in {near, by}:
        part.release()
    return root


def aggregate_sequential(a: Mat, symmetric: bool = False) -> DataFrame:
    """(i, root): in order of index a node without decided neighbours becomes a root and takes its neighbours; left-over nodes
    join the first of their neighbours that were decided by then. A pattern that is known to be symmetric is packed once."""
    if influence(a).limit(LOCAL_ENTRIES + 1).count() > LOCAL_ENTRIES:
        return to_table(a.df.sparkSession, "i long, root long", np.arange(a.m), _aggregate_rounds(influence(a), a.m, symmetric))
    e = _gathered(influence(a))
    near = [[] for _ in range(a.m)]
    for i, j in zip(e["i"].tolist(), e["j"].tolist(), strict=True):
        near[i].append(j)
    root = np.full(a.m, -1)
    for k in range(a.m):
        if root[k] < 0 and all(root[x] < 0 for x in near[k]):
            root[[k, *near[k]]] = k
    rest = np.flatnonzero(root < 0)
    root[rest] = [next(root[x] for x in near[k] if root[x] >= 0) for k in rest]
    return a.df.sparkSession.createDataFrame(pd.DataFrame({"i": np.arange(a.m), "root": root}), "i long, root long")


def aggregate_mis2(a: Mat, seed: int = 0) -> DataFrame:
    """(i, root) from a distance-2 independent set: each round spreads the greatest (state, weight, index) over neighbours twice; a node that is its own maximum is a root."""
    edges = checkpoint(influence(a))
    if driver_sized(a.m):
        return _mis2_arrays(Mat(edges.withColumn("v", F.lit(1.0)), a.m, a.m), seed)
    nodes = a.df.sparkSession.range(a.m).select(F.col("id").alias("i"), F.lit(1).alias("state"), F.xxhash64(F.lit(seed), "id").alias("w"))
    while True:
        best = nodes.select("i", F.struct("state", "w", F.col("i").alias("at")).alias("b"))
        own = best
        for _ in range(2):
            spread = edges.join(best.select(F.col("i").alias("j"), F.col("b").alias("nb")), "j").groupBy("i").agg(F.max("nb").alias("nb"))
            best = best.join(spread, "i", "left").select("i", F.greatest("b", F.coalesce("nb", "b")).alias("b"))
        joined = own.withColumnRenamed("b", "o").join(best, "i")
        nxt = F.when(F.col("o.state") != 1, F.col("o.state")).when(F.col("b.at") == F.col("i"), 2).when(F.col("b.state") == 2, 0).otherwise(1)
        nodes = checkpoint(joined.select("i", nxt.alias("state"), F.col("o.w").alias("w")))
        if not nodes.where("state = 1").limit(1).count():
            break
    root = checkpoint(nodes.select("i", F.when(F.col("state") == 2, F.col("i")).alias("root")))
    for _ in range(2):  # a root is at most two steps away
        near = edges.join(root.where("root is not null").select(F.col("i").alias("j"), "root"), "j").groupBy("i").agg(F.min("root").alias("r"))
        root = checkpoint(root.join(near, "i", "left").select("i", F.coalesce("root", "r").alias("root")))
    return root.select("i", F.coalesce("root", "i").alias("root"))


def _longs(df: DataFrame, n: int) -> np.ndarray:
    got, out = df.toPandas(), np.zeros(n, np.int64)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out


def _mis2_arrays(edges: Mat, seed: int) -> DataFrame:
    """The same with (state, weight, index) as one number a node, on the driver; a spread is one job over the edges."""
    spark, n = edges.df.sparkSession, edges.m
    near = packed(edges)
    weights = _longs(spark.range(n).select(F.col("id").alias("i"), F.xxhash64(F.lit(seed), "id").alias("v")), n)
    by_rank = np.lexsort((np.arange(n), weights))
    rank = np.empty(n, np.int64)
    rank[by_rank] = np.arange(n)
    state = np.ones(n, np.int64)
    while (state == 1).any():
        best = state * n + rank
        for _ in range(2):
            best = np.maximum(best, near.most(best))
        top = by_rank[best % n] == np.arange(n)
        state = np.where(state != 1, state, np.where(top, 2, np.where(best // n == 2, 0, 1)))
    root = np.where(state == 2, np.arange(n), -1)
    for _ in range(2):  # a root is at most two steps away; the smallest of several is taken
        seen = near.most(np.where(root >= 0, n - root, 0))
        root = np.where(root >= 0, root, np.where(seen > 0, n - seen, -1))
    near.release()
    root = np.where(root >= 0, root, np.arange(n))
    return spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "root": root}), "i long, root long")


def _numbered(nodes: DataFrame, name: str) -> DataFrame:
    """(node, c): consecutive numbers by index, through counts of index ranges."""
    ids = nodes.select(F.col(name).alias("node")).distinct().withColumn("range", F.expr("node div 65536"))
    from pyspark.sql import Window

    counts = ids.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return ids.join(starts, "range").select("node", (F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy("node")) - 1).alias("c"))


def interpolate_aggregates(a: Mat, root: DataFrame) -> Mat:
    """Each node takes its aggregate's value."""
    number = checkpoint(_numbered(root, "root"))
    p = root.join(number, F.col("root") == F.col("node")).select("i", F.col("c").alias("j"), F.lit(1.0).alias("v"))
    return Mat(p, a.m, number.count())


def interpolate_smoothed(a: Mat, root: DataFrame, weight: float = 1.0) -> Mat:
    """(I - w D^-1 A) applied to the aggregates' interpolation."""
    t = interpolate_aggregates(a, root)
    d = a.df.where(F.col("i") == F.col("j")).select(F.col("i").alias("k"), F.col("v").alias("d"))
    s = Mat(a.df.join(d, F.col("i") == F.col("k")).select("i", "j", (F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) - weight * F.col("v") / F.col("d")).alias("v")), a.m, a.n)
    return multiply(s, Mat(checkpoint(t.df), t.m, t.n))


def interpolate_direct(a: Mat, state: DataFrame, threshold: float = 0.1) -> Mat:
    """Coarse nodes keep their value; a fine node takes t a_ic of its strong coarse neighbours c, where t makes up for all off-diagonal entries; it stays empty if |t| <= 0.01 |a_ii|."""
    coarse = state.where(F.col("state") == COARSE)
    number = checkpoint(_numbered(coarse, "i"))
    own = number.select(F.col("node").alias("i"), F.col("c").alias("j"), F.lit(1.0).alias("v"))
    sums = a.df.groupBy("i").agg(F.sum(F.when(F.col("i") != F.col("j"), F.col("v"))).alias("off"), F.max(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("d"))
    strong = influence(a, threshold).join(number.select(F.col("node").alias("j"), "c"), "j").join(a.df, ["i", "j"])
    fine = strong.join(coarse.select("i"), "i", "left_anti")
    total = fine.groupBy("i").agg(F.sum("v").alias("s")).join(sums, "i").select("i", (-F.col("off") / (F.col("d") * F.col("s"))).alias("t"), "d")
    rest = fine.join(total.where(F.abs("t") > 0.01 * F.abs("d")), "i").select("i", F.col("c").alias("j"), (F.col("t") * F.col("v")).alias("v"))
    return Mat(own.unionByName(rest), a.m, number.count())


def smooth_jacobi(a: Mat, b: DataFrame, x: DataFrame, weight: float = 1.0, steps: int = 1) -> DataFrame:
    """x = w D^-1 (b - R x) + (1 - w) x, R the off-diagonal part."""
    d = a.df.where(F.col("i") == F.col("j")).select("i", F.col("v").alias("d"))
    off = Mat(a.df.where(F.col("i") != F.col("j")), a.m, a.n)
    for _ in range(steps):
        rx = gemv(off, Vec(x, a.n)).df.withColumnRenamed("v", "rx")
        all_ = d.join(b.withColumnRenamed("v", "b"), "i", "left").join(rx, "i", "left").join(x.withColumnRenamed("v", "x"), "i", "left")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        x = all_.select("i", (weight * (zero("b") - zero("rx")) / F.col("d") + (1 - weight) * zero("x")).alias("v"))
    return x


@dataclass
class Multigrid:
    """A hierarchy of levels; calling it applies one V-cycle from zero."""

    weight: float = 2 / 3
    before: int = 2
    after: int = 2
    levels: list[tuple[Mat, Mat]] = field(default_factory=list)
    coarsest: np.ndarray | None = None

    packs: list | None = None

    def __call__(self, r: DataFrame) -> DataFrame:
        return self._cycle(0, r)

    @property
    def arrays(self):
        """The V-cycle on arrays, None where they would be too long for the driver."""
        if not driver_sized(self.levels[0][0].m if self.levels else 0):
            return None
        if self.packs is None:
            diagonal = lambda a: to_array(a.df.where(F.col("i") == F.col("j")), a.m)
            self.packs = [(packed(a), diagonal(a), packed(p)) for a, p in self.levels]
        return lambda r: self._cycle_arrays(0, r)

    def _cycle_arrays(self, k: int, b: np.ndarray) -> np.ndarray:
        if k == len(self.levels):
            return self.coarsest @ b
        a, d, p = self.packs[k]
        x = self.weight * b / d
        for _ in range(self.before - 1):
            x = x + self.weight * (b - a.times(x)) / d
        rest = b - a.times(x) if self.before else b
        x = (x if self.before else 0) + p.times(self._cycle_arrays(k + 1, p.times_t(rest)))
        for _ in range(self.after):
            x = x + self.weight * (b - a.times(x)) / d
        return x

    def _cycle(self, k: int, b: DataFrame) -> DataFrame:
        if k == len(self.levels):
            inverse, n = self.coarsest, len(self.coarsest)
            i, j = np.indices(inverse.shape)
            m = b.sparkSession.createDataFrame(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": inverse.ravel()}), "i long, j long, v double")
            return gemv(Mat(m, n, n), Vec(b, n)).df
        a, p = self.levels[k]
        x = smooth_jacobi(a, b, b.withColumn("v", F.lit(0.0)), self.weight, self.before)
        x = checkpoint(x)
        rest = axpby(1.0, b, -1.0, gemv(a, Vec(x, a.n)).df, sparse=True)
        coarse = self._cycle(k + 1, checkpoint(gemv(p, Vec(rest, a.n), transposed=True).df))
        x = axpby(1.0, x, 1.0, gemv(p, Vec(coarse, p.n)).df, sparse=True)
        return checkpoint(smooth_jacobi(a, b, x, self.weight, self.after))


def multigrid(a: Mat, coarsening: str = "mis2", interpolation: str = "aggregate", threshold: float = 0.1, cutoff: int = 50, weight: float = 2 / 3) -> Multigrid:
    """The hierarchy down to at most `cutoff` unknowns. Coarsenings: onepass (with direct interpolation), sequential, mis2; interpolations: direct, aggregate, smoothed. A level that does not shrink raises."""
    need((coarsening == "onepass") == (interpolation == "direct"), "onepass goes with direct interpolation, aggregates with the others")
    out = Multigrid(weight=weight)
    while a.m > cutoff:
        if coarsening == "onepass":
            p = interpolate_direct(a, coarsen_onepass(a, threshold), threshold)
        else:
            root = aggregate_sequential(a) if coarsening == "sequential" else aggregate_mis2(a)
            p = interpolate_smoothed(a, root) if interpolation == "smoothed" else interpolate_aggregates(a, root)
        if not 0 < p.n < a.m:
            raise ValueError(f"no progress in coarsening at {a.m} unknowns")
        p = Mat(checkpoint(p.df), p.m, p.n)
        c = galerkin(p, a)
        out.levels.append((a, p))
        a = Mat(checkpoint(c.df), c.m, c.n)
    out.coarsest = np.linalg.inv(to_numpy(a))
    return out
