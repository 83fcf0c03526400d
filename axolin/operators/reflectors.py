"""QR of matrices of many rows with its reflectors kept, so that Q is orthogonal whatever the condition or the rank.

Rows are reduced in blocks of consecutive ones, and the triangular factors of `fan` neighbours at a time up a tree, one
level a job. Every node keeps its reflectors in compact form, Q = I - V T V^T (V below a unit diagonal, T upper triangular),
in a checkpointed table of its level. Q^T B goes up that tree: each node reflects its rows of B and hands the upper ones
on. Q C goes down it: the root's part of C is reflected and dealt to the children, until the blocks hold rows of the
product. A node's message has as many rows as its factor (n at most), so what moves is nodes * n * columns values, and no
task holds more than a block or `fan` factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axolin.plans.loop import checkpoint
from axolin.types import LOCAL_ENTRIES, Mat, need

_NODE = "node long, height int, v binary, t binary, r binary, kids array<long>, parts array<int>"
#: Cells of a block of rows.
BLOCK_CELLS = 1 << 20


def reflect(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(V, T, R) with x = (I - V T V^T) [R; 0], for any shape and rank."""
    m, n = x.shape
    k = min(m, n)
    h, tau = np.linalg.qr(x, mode="raw")
    v = np.tril(h.T[:, :k], -1)
    v[np.arange(k), np.arange(k)] = 1.0
    t, inner = np.zeros((k, k)), v.T @ v
    for c in range(k):
        t[:c, c] = -tau[c] * (t[:c, :c] @ inner[:c, c])
        t[c, c] = tau[c]
    return v, t, np.triu(h.T[:k])


def _times(v: np.ndarray, t: np.ndarray, c: np.ndarray, transposed: bool) -> np.ndarray:
    return c - v @ ((t.T if transposed else t) @ (v.T @ c))


def _arrays(row, n: int) -> tuple[np.ndarray, np.ndarray]:
    k = min(row.height, n)
    return np.frombuffer(row.v).reshape(row.height, k), np.frombuffer(row.t).reshape(k, k)


def _node(node: int, x: np.ndarray, kids: list[int], parts: list[int]) -> pd.DataFrame:
    v, t, r = reflect(x)
    return pd.DataFrame({"node": [node], "height": [len(x)], "v": [np.ascontiguousarray(v).tobytes()], "t": [t.tobytes()], "r": [r.tobytes()], "kids": [kids], "parts": [parts]})


@dataclass(frozen=True)
class Reflectors:
    """The tree of an m x n matrix: for each level a table of nodes, blocks first, and R with signs that make its
    diagonal non-negative."""

    m: int
    n: int
    rows: int
    levels: list[DataFrame]
    r: np.ndarray
    signs: np.ndarray

    def transposed_times(self, b: Mat) -> np.ndarray:
        """Q^T B, as many rows as R has, on the driver."""
        need(b.m == self.m, "a fitting right-hand side is needed")
        k, n, rows = b.n, self.n, self.rows
        if not self.levels:
            return np.zeros((0, k))
        ddl = "node long, c binary"

        def block(key, node: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
            if not len(node):
                return pd.DataFrame({"node": [], "c": []})
            at = node.iloc[0]
            c = np.zeros((at["height"], k))
            c[cells["i"].to_numpy(np.int64) - int(key[0]) * rows, cells["j"].to_numpy(np.int64)] = cells["v"]
            return pd.DataFrame({"node": [key[0]], "c": [_times(*_arrays(at, n), c, True)[: min(len(c), n)].tobytes()]})

        right = b.df.select(F.expr(f"i div {rows}").alias("node"), "i", "j", "v")
        up = self.levels[0].select("node", "height", "v", "t").groupBy("node").cogroup(right.groupBy("node")).applyInPandas(block, ddl)

        def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("kid")
            c = np.vstack([np.frombuffer(x).reshape(-1, k) for x in pdf["c"]])
            return pd.DataFrame({"node": [key[0]], "c": [_times(*_arrays(pdf.iloc[0], n), c, True)[: min(len(c), n)].tobytes()]})

        for level in self.levels[1:]:
            kids = level.select("node", "height", "v", "t", F.explode("kids").alias("kid"))
            up = kids.join(checkpoint(up).withColumnRenamed("node", "kid"), "kid").groupBy("node").applyInPandas(merge, ddl)
        (top,) = up.collect()  # one row of n x k cells
        return self.signs[:, None] * np.frombuffer(top.c).reshape(-1, k)

    def times(self, c: np.ndarray) -> Mat:
        """Q C for C with as many rows as R has."""
        n, m, rows = self.n, self.m, self.rows
        need(len(c) == len(self.r), "C must have as many rows as R")
        k = c.shape[1]
        ddl = "i long, j long, v double"
        spread = lambda at, part: _times(*_arrays(at, n), np.vstack([part, np.zeros((at.height - len(part), k))]), False)

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for at in pdf.itertuples(index=False):
                    y = spread(at, np.frombuffer(at.c).reshape(-1, k))
                    ends = np.cumsum([0, *at.parts])
                    yield pd.DataFrame({"node": at.kids, "c": [y[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]})

        def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for at in pdf.itertuples(index=False):
                    y = spread(at, np.frombuffer(at.c).reshape(-1, k))[: m - at.node * rows]
                    yield pd.DataFrame({"i": np.repeat(np.arange(len(y)) + at.node * rows, k), "j": np.tile(np.arange(k), len(y)), "v": y.ravel()})

        if not self.levels:
            raise ValueError("a matrix without entries has no Q")
        spark = self.levels[0].sparkSession
        start = np.ascontiguousarray(self.signs[:, None] * c)
        down = self.levels[-1].select("node").crossJoin(F.broadcast(spark.createDataFrame([(start.tobytes(),)], "c binary")))
        for level in self.levels[:0:-1]:
            down = checkpoint(level.select("node", "height", "v", "t", "kids", "parts").join(down, "node").mapInPandas(deal, "node long, c binary"))
        return Mat(self.levels[0].select("node", "height", "v", "t").join(down, "node").mapInPandas(cells, ddl), m, k)

    def q(self) -> Mat:
        """The orthonormal columns of Q, m x min(n, rows)."""
        return self.times(np.eye(len(self.r)))


def factor(a: Mat, fan: int = 8, rows: int | None = None) -> Reflectors:
    """The reflectors of A, for at most sqrt(LOCAL_ENTRIES) columns; `rows` rows make a block (2^20 cells by default).
    Blocks without entries take no part: their rows of Q are zero."""
    n = a.n
    need(n * n <= LOCAL_ENTRIES and fan > 1, "too many columns, or a fan under 2")
    rows = rows or max(2 * n, BLOCK_CELLS // max(1, n))
    fan = max(2, min(fan, 2 * LOCAL_ENTRIES // max(1, n * n)))
    m = a.m

    def block(key, pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(key[0]) * rows
        x = np.zeros((min(rows, m - at), n))
        x[pdf["i"].to_numpy(np.int64) - at, pdf["j"].to_numpy(np.int64)] = pdf["v"]
        return _node(key[0], x, [], [])

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        found = [np.frombuffer(x).reshape(-1, n) for x in pdf["r"]]
        return _node(key[0], np.vstack(found), pdf["node"].tolist(), [len(x) for x in found])

    levels = [checkpoint(a.df.groupBy(F.expr(f"i div {rows}").alias("block")).applyInPandas(block, _NODE))]
    count = levels[0].count()
    if not count:
        return Reflectors(m, n, rows, [], np.zeros((0, n)), np.zeros(0))
    # the nodes of a level are numbered without gaps, so that each merge has its full fan
    while count > 1:
        level = levels[-1]
        if len(levels) == 1:
            known = sorted(r.node for r in level.select("node").collect())  # one number for each block
            place = {k: p for p, k in enumerate(known)}
            places = a.df.sparkSession.createDataFrame(list(place.items()), "node long, place long")
            level = level.join(F.broadcast(places), "node")
        else:
            level = level.withColumn("place", F.col("node"))
        levels.append(checkpoint(level.select(F.expr(f"place div {fan}").alias("up"), "node", "r").groupBy("up").applyInPandas(merge, _NODE)))
        count = -(-count // fan)
    r = np.frombuffer(levels[-1].first().r).reshape(-1, n)
    d = np.diag(r)
    signs = np.where(np.append(d, np.zeros(len(r) - len(d))) < 0, -1.0, 1.0)
    return Reflectors(m, n, rows, levels, signs[:, None] * r, signs)
