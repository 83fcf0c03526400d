"""Orderings that reduce bandwidth: (i, p), the new place of each index.

The graph stays distributed, in packed chunks of its entries (plans.blocks); what is known of each node (its layer, place
and component) is an array on the driver, of types.DRIVER_ROWS nodes at most. Breadth-first search goes layer by layer,
one job for each: every node next to the last layer's nodes gets the least place among them, by which the next layer is
numbered. A layer of few entries gives its places to its neighbours; of a larger one every node looks for the least place
among its own entries, so what comes back is a number a node at most, however many entries there are. All components advance side by side, so their number costs no jobs, and
they are found by hooking and pointer jumping in a logarithmic number of jobs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axolin.operators.substitution import _ranges
from axolin.plans.blocks import laid_out, packed
from axolin.types import Mat, driver_sized, need

_NONE = np.iinfo(np.int64).max


def _give(rows, at, cols, vals, front: np.ndarray, value: np.ndarray):
    """(node, least value) over the neighbours of the nodes of a sorted front."""
    places, which = _ranges(rows, at, len(cols), front)
    to, v = cols[places], value[which]
    order = np.lexsort((v, to))
    to, v = to[order], v[order]
    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
    return to[first], v[first]


def _look(rows, at, cols, vals, value: np.ndarray):
    """(node, least value) over the neighbours that have one."""
    v = np.minimum.reduceat(value[cols], at)
    there = np.flatnonzero(v < np.iinfo(v.dtype).max)
    return rows[there].astype(np.int32), v[there]


def _degrees(rows, at, cols, vals):
    return rows, np.diff(np.append(at, len(cols)))


class Graph:
    """The symmetric pattern of a matrix without its diagonal."""

    def __init__(self, a: Mat, symmetric: bool = False):
        need(a.m == a.n and driver_sized(a.m), "the matrix must be square and its vectors must fit the driver")
        e = a.df.where("i != j").select("i", "j")
        both = e if symmetric else e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
        self.n, self.spark = a.m, a.df.sparkSession
        self.part = packed(Mat(both.withColumn("v", F.lit(1.0)), a.m, a.n), pattern=True)
        self.degree = np.zeros(self.n, np.int64)
        for rows, count in self.part.each(_degrees):
            self.degree[rows] += count
        #: Nodes by degree, then index, and each node's place there.
        self.order = np.lexsort((np.arange(self.n), self.degree))
        self.rank = np.empty(self.n, np.int64)
        self.rank[self.order] = np.arange(self.n)

    def least(self, front: np.ndarray, value: np.ndarray) -> np.ndarray:
        """For every node the least value among its neighbours in the front."""
        out = np.full(self.n, _NONE)
        if self.degree[front].sum() <= self.n:
            order = np.argsort(front)
            found = self.part.each(_give, front[order], value[order])
        else:
            all_ = np.full(self.n, np.iinfo(np.int32).max, np.int32)
            all_[front] = value
            found = self.part.each(_look, all_)
        for to, v in found:
            out[to] = np.minimum(out[to], v)
        return out

    def components(self, among: np.ndarray) -> np.ndarray:
        """For the nodes of a mask the least rank in their component within it; other nodes are alone."""
        lab, nodes = self.rank.copy(), np.flatnonzero(among)
        while len(nodes):
            best = np.where(among, np.minimum(lab, self.least(nodes, lab[nodes])), lab)
            new = best.copy()
            np.minimum.at(new, self.order[lab[nodes]], best[nodes])
            while not np.array_equal(jump := new[self.order[new]], new):
                new = jump
            if (new == lab).all():
                break
            lab = new
        return lab

    def search(self, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes in the order of their visit, layer, number of the root) breadth-first from one root in each of some
        components; a layer is ordered by the parent's place, then degree, then index. Nodes out of reach have layer -1."""
        layer, of = np.full(self.n, -1), np.full(self.n, -1)
        visited, count, depth = np.empty(self.n, np.int64), 0, 0
        new, of[roots] = roots, np.arange(len(roots))
        while len(new):
            visited[count : count + len(new)] = new
            layer[new], places = depth, count + np.arange(len(new))
            count, depth = count + len(new), depth + 1
            parent = self.least(new, places)
            new = np.flatnonzero((parent < _NONE) & (layer < 0))
            new = new[np.lexsort((new, self.degree[new], parent[new]))]
            of[new] = of[visited[parent[new]]]
        return visited[:count], layer, of

    def spread(self, place: np.ndarray, of: np.ndarray, parts: int) -> np.ndarray:
        """For each part the greatest distance of the places of two neighbours."""

        def run(rows, at, cols, vals, place, of):
            d = np.abs(place[cols] - np.repeat(place[rows], np.diff(np.append(at, len(cols)))))
            most = np.zeros(parts, np.int64)
            known = of[rows] >= 0
            np.maximum.at(most, of[rows][known], np.maximum.reduceat(d, at)[known])
            there = np.flatnonzero(most)
            return there, most[there]

        out = np.zeros(parts, np.int64)
        for part, most in self.part.each(run, place.astype(np.int32), of.astype(np.int32)):
            out[part] = np.maximum(out[part], most)
        return out

    def ends(self, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(depth, least node of the deepest layer, layers, root's number) of the layerings from some roots."""
        _, layer, of = self.search(roots)
        depth = np.zeros(len(roots), np.int64)
        there = np.flatnonzero(of >= 0)
        np.maximum.at(depth, of[there], layer[there])
        last = there[layer[there] == depth[of[there]]]
        last = last[np.argsort(self.rank[last])[::-1]]
        least = np.empty(len(roots), np.int64)
        least[of[last]] = last  # the least one is assigned last
        return depth, least, layer, of

    def far(self, roots: np.ndarray) -> np.ndarray:
        """For each component a node whose layering is as deep as can be found by moving to the last layer."""
        roots = roots.copy()
        depth, last, _, _ = self.ends(roots)
        active = np.arange(len(roots))
        while len(active):
            deeper, ends, _, _ = self.ends(last[active])
            better = deeper > depth[active]
            on = active[better]
            roots[on], depth[on], last[on] = last[on], deeper[better], ends[better]
            active = on
        return roots

    def roots(self) -> np.ndarray:
        """The node of least degree (and index) of every component, in that order."""
        lab = self.components(np.ones(self.n, bool))
        found = np.flatnonzero(lab == self.rank)
        return found[np.argsort(self.rank[found])]

    def frame(self, order: np.ndarray) -> DataFrame:
        self.part.release()
        return laid_out(self.spark, "i long, p long", len(order), lambda a, b, order: (order[a:b], np.arange(a, b)), order.astype(np.int32))


def by_degree(a: Mat) -> DataFrame:
    """(i, degree, p): places in the order of the number of neighbours, then of the index. Places are offsets by degree,
    from one row a degree, and numbers within ranges of nodes of one degree."""
    from pyspark.sql import Window

    seen = a.df.where("i != j").groupBy("i").agg(F.count(F.lit(1)).alias("degree"))
    nodes = a.df.sparkSession.range(a.m).select(F.col("id").alias("i")).join(seen, "i", "left").select("i", F.coalesce("degree", F.lit(0)).alias("degree"), F.expr("i div 65536").alias("part"))
    counts = nodes.groupBy("degree", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("degree", "part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("degree", "part", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("degree", "part").orderBy("i"))
    return nodes.withColumn("at", inside).join(starts, ["degree", "part"]).select("i", "degree", (F.col("start") + F.col("at") - 1).alias("p"))


def cuthill_mckee(a: Mat, symmetric: bool = False) -> DataFrame:
    """Components from a node of least degree each, layer by layer, neighbours by degree. A pattern that is known to be
    symmetric need not be made so."""
    g = Graph(a, symmetric)
    visited, _, of = g.search(g.roots())
    return g.frame(visited[np.argsort(of[visited], kind="stable")])


def advanced_cuthill_mckee(a: Mat, roots: int = 4, symmetric: bool = False) -> DataFrame:
    """For each component the best of the orderings from several nodes of small degree and a far one."""
    g = Graph(a, symmetric)
    first = g.roots()
    _, _, of = g.search(first)
    nodes = np.lexsort((g.rank, of))  # of each component, by degree and index
    start = np.searchsorted(of[nodes], np.arange(len(first)))
    size = np.diff(np.append(start, g.n))
    best, place = np.full(len(first), _NONE), np.zeros(g.n, np.int64)
    for t in [*range(roots), None]:
        parts = np.arange(len(first)) if t is None else np.flatnonzero(size > t)
        tries = g.far(first) if t is None else nodes[start[parts] + t]
        visited, _, number = g.search(tries)
        at = np.full(g.n, 0)
        ordered = visited[np.argsort(number[visited], kind="stable")]
        at[ordered] = np.arange(len(ordered))
        spread = g.spread(at, number, len(tries))
        better = spread < best[parts]
        best[parts[better]] = spread[better]
        moved = visited[better[number[visited]]]
        place[moved] = at[moved]
    return g.frame(np.lexsort((place, of)))


def gibbs_poole_stockmeyer(a: Mat, ends: int = 8, symmetric: bool = False) -> DataFrame:
    """Layers combined from both ends of a long path through each component, numbered layer by layer by degree. The
    second end is the one with the narrowest layers among the `ends` nodes of least degree in the last layer."""
    g = Graph(a, symmetric)
    one_end = g.far(g.roots())
    depth, _, front, of = g.ends(one_end)
    parts = len(one_end)
    deep = np.flatnonzero(front == depth[of])
    deep = deep[np.lexsort((g.rank[deep], of[deep]))]
    start = np.searchsorted(of[deep], np.arange(parts))
    size = np.diff(np.append(start, len(deep)))
    narrow, other, back = np.full(parts, _NONE), np.empty(parts, np.int64), np.zeros(g.n, np.int64)
    for t in range(ends):
        there = np.flatnonzero(size > t)
        if not len(there):
            break
        tries = deep[start[there] + t]
        _, layer, number = g.search(tries)
        seen = np.flatnonzero(number >= 0)
        width = np.zeros(len(there), np.int64)
        deepest = int(layer.max()) + 1
        pairs, counts = np.unique(number[seen] * deepest + layer[seen], return_counts=True)
        np.maximum.at(width, pairs // deepest, counts)
        better = width < narrow[there]
        narrow[there[better]], other[there[better]] = width[better], tries[better]
        moved = seen[better[number[seen]]]
        back[moved] = layer[moved]
    two = np.maximum(0, depth[of] - back)
    level, undecided = np.where(front == two, front, -1), front != two
    base = np.concatenate([[0], np.cumsum(depth + 1)])[:-1][of]  # where a component's levels begin among all
    width = np.bincount((base + level)[~undecided], minlength=int((depth + 1).sum()))
    lab = g.components(undecided)
    loose = np.flatnonzero(undecided)
    loose = loose[np.lexsort((loose, lab[loose]))]
    first = np.flatnonzero(np.diff(lab[loose], prepend=-1))
    last = np.append(first[1:], len(loose))
    for k in np.lexsort((loose[first], first - last)):
        part = loose[first[k] : last[k]]
        choice = min((front, two), key=lambda w: (width[base[part] + w[part]].max() + 1, w is two))
        level[part] = choice[part]
        np.add.at(width, base[part] + level[part], 1)
    near, seq, count = np.full(g.n, _NONE), np.empty(g.n, np.int64), 0
    for d in range(int(level.max(initial=-1)) + 1):
        now = np.flatnonzero(level == d)
        now = now[np.lexsort((now, g.degree[now], near[now]))]
        seq[now] = count + np.arange(len(now))
        count += len(now)
        near = np.minimum(near, g.least(now, seq[now]))
    return g.frame(np.lexsort((seq, of)))
