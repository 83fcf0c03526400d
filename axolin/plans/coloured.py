"""Incomplete factors of a whole matrix by colours.

Rows without an entry between them share a colour. In the order of colours (and of indices within one) a row depends on
rows of earlier colours alone, so all rows of a colour are eliminated side by side: each is joined with the finished rows
that it depends on, and a task eliminates its rows. The factors are those that the sequential elimination gives in that
order. Triangular solves go colour by colour as well, one product each.

Colours come from random priorities (Jones and Plassmann): in each round every node that comes before all its open
neighbours takes the least colour that none of them has; a round is one job over the packed graph, and their number is
logarithmic. Then each colour's nodes, last colour first, take the least colour that is free by now, which leaves
fewer colours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axolin.operators.product import gemv
from axolin.plans.blocks import Both, packed, to_array
from axolin.plans.loop import checkpoint
from axolin.plans.reorder import Graph
from axolin.types import Mat, Vec, need

#: Colours are kept as bits of a long.
MOST_COLOURS = 62


def _view(priority: np.ndarray, colour: np.ndarray):
    """(row, least priority of its open neighbours, bits of its neighbours' colours) of every row of a chunk."""

    def run(rows, at, cols, vals):
        there = colour[cols]
        bits = np.where(there >= 0, np.int64(1) << np.maximum(there, 0), 0)
        return rows, np.minimum.reduceat(np.where(there < 0, priority[cols], np.iinfo(np.int64).max), at), np.bitwise_or.reduceat(bits, at)

    return run


def _seen(g: Graph, priority: np.ndarray, colour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    least, bits = np.full(g.n, np.iinfo(np.int64).max), np.zeros(g.n, np.int64)
    for rows, low, used in g.part.each(_view(priority, colour)):
        least[rows] = np.minimum(least[rows], low)
        bits[rows] |= used
    return least, bits


def _free(bits: np.ndarray) -> np.ndarray:
    """The lowest bit that is not set."""
    low = ~bits & (bits + 1)
    need(bool((low < np.int64(1) << MOST_COLOURS).all()), f"more than {MOST_COLOURS} colours are needed")
    return np.round(np.log2(low.astype(float))).astype(np.int64)


def colours(a: Mat, seed: int = 1) -> np.ndarray:
    """A colour for each row, different from those of all rows that it has an entry with, either way round."""
    g = Graph(a)
    priority, colour = np.random.default_rng(seed).permutation(g.n), np.full(g.n, -1)
    while (colour < 0).any():
        least, bits = _seen(g, priority, colour)
        now = (colour < 0) & (priority < least)
        colour[now] = _free(bits[now])
    for c in range(int(colour.max(initial=0)), 0, -1):
        _, bits = _seen(g, priority, colour)
        now = colour == c
        colour[now] = np.minimum(c, _free(bits[now]))
    g.part.release()
    _, colour = np.unique(colour, return_inverse=True)
    return colour


def _eliminate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (i, js, vs) with the finished rows (k, js, vs) that they depend on, in ascending order of k."""
    for pdf in frames:
        out = []
        for row in pdf.itertuples(index=False):
            js, w = np.asarray(row.js), np.array(row.vs, float)
            for d in row.done if row.done is not None else ():
                k, cols, vals = int(d["k"]), np.asarray(d["js"]), np.asarray(d["vs"], float)
                pivot = vals[np.searchsorted(cols, k)] if k in cols else 0.0
                if pivot == 0:
                    raise ZeroDivisionError(f"zero pivot in row {k}")
                at = np.searchsorted(js, k)
                w[at] /= pivot
                right = cols > k
                there = np.searchsorted(js, cols[right])
                there[there == len(js)] = 0
                both = js[there] == cols[right]
                w[there[both]] -= w[at] * vals[right][both]
            out.append(w)
        yield pd.DataFrame({"i": pdf["i"], "js": pdf["js"], "vs": out})


def factor(a: Mat, colour: np.ndarray, positive: bool = False) -> tuple[DataFrame, np.ndarray]:
    """((i, j, v): L below a unit diagonal and U, in the pattern of A, rows and columns in the order of colours; the new
    place of each row). With positive a pivot that is not raises."""
    need(a.m == a.n == len(colour), "a square matrix and a colour for each row are needed")
    spark = a.df.sparkSession
    order = np.lexsort((np.arange(a.m), colour))
    place = np.empty(a.m, np.int64)
    place[order] = np.arange(a.m)
    places = spark.createDataFrame(pd.DataFrame({"at": np.arange(a.m), "p": place, "c": colour}), "at long, p long, c int")
    e = a.df.join(places, F.col("i") == F.col("at")).select(F.col("p").alias("pi"), "c", "j", "v")
    e = e.join(places.select("at", F.col("p").alias("pj"), F.col("c").alias("cj")), F.col("j") == F.col("at"))
    if e.where("pi != pj AND c = cj").limit(1).count():
        raise ValueError("two rows of one colour have an entry between them")
    cell = F.array_sort(F.collect_list(F.struct("pj", "v", "cj")))
    rows = e.groupBy(F.col("pi").alias("i"), "c").agg(cell.alias("cells"))
    rows = checkpoint(rows.select("i", "c", F.col("cells.pj").alias("js"), F.col("cells.v").alias("vs"), F.transform(F.filter("cells", lambda x: x["cj"] < F.col("c")), lambda x: x["pj"]).alias("needs")))
    ddl, done = "i long, js array<long>, vs array<double>", None
    for c in range(int(colour.max(initial=-1)) + 1):
        mine = rows.where(F.col("c") == c)
        if done is None:
            ready = mine.withColumn("done", F.lit(None).cast("array<struct<k:bigint,js:array<bigint>,vs:array<double>>>"))
        else:
            asked = mine.select("i", F.explode("needs").alias("k")).join(done.select(F.col("i").alias("k"), F.col("js"), F.col("vs")), "k")
            held = asked.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("k", "js", "vs"))).alias("done"))
            ready = mine.join(held, "i", "left")
        got = checkpoint(ready.select("i", "js", "vs", "done").mapInPandas(_eliminate, ddl))
        done = got if done is None else done.unionByName(got)
    cells = done.select("i", F.explode(F.arrays_zip("js", "vs")).alias("x")).select("i", F.col("x.js").alias("j"), F.col("x.vs").alias("v"))
    if positive and cells.where("i = j AND v <= 0").limit(1).count():
        raise ZeroDivisionError("a pivot is not positive")
    return checkpoint(cells), place


def incomplete(a: Mat, kind: str = "ilu0", seed: int = 1):
    """A preconditioner from the incomplete factors of the whole matrix in the order of its colours: ilu0, or ichol0 for
    symmetric matrices, where U is D L^T and pivots must be positive."""
    need(kind in ("ilu0", "ichol0"), "the kind is ilu0 or ichol0")
    colour = colours(a, seed)
    cells, place = factor(a, colour, kind == "ichol0")
    n, ends = a.m, np.concatenate([[0], np.cumsum(np.bincount(colour))])
    spans = list(zip(ends.tolist(), ends[1:].tolist(), strict=False))
    row_in = lambda lo, hi: (F.col("i") >= lo) & (F.col("i") < hi)
    low = [cells.where(row_in(lo, hi) & (F.col("j") < lo)) for lo, hi in spans]
    up = [cells.where(row_in(lo, hi) & (F.col("j") >= hi)) for lo, hi in spans]
    diagonal = cells.where("i = j").select("i", F.col("v").alias("d"))

    def arrays():
        lows, ups = [packed(Mat(x, n, n)) for x in low[1:]], [packed(Mat(x, n, n)) for x in up[:-1]]
        d = to_array(diagonal.withColumnRenamed("d", "v"), n)

        def solve(r: np.ndarray) -> np.ndarray:
            y = np.empty(n)
            y[place] = r
            for (lo, hi), part in zip(spans[1:], lows, strict=True):
                y[lo:hi] -= part.times(y)[lo:hi]
            y[spans[-1][0] :] /= d[spans[-1][0] :]
            for (lo, hi), part in zip(spans[-2::-1], ups[::-1], strict=True):
                y[lo:hi] = (y[lo:hi] - part.times(y)[lo:hi]) / d[lo:hi]
            return y[place]

        return solve

    def frames(r: DataFrame) -> DataFrame:
        spark = r.sparkSession
        places = spark.createDataFrame(pd.DataFrame({"at": np.arange(n), "p": place}), "at long, p long")
        y = checkpoint(r.join(places, F.col("i") == F.col("at")).select(F.col("p").alias("i"), "v"))

        def less(y: DataFrame, part: DataFrame, lo: int, hi: int, divided: bool) -> DataFrame:
            given = gemv(Mat(part, n, n), Vec(y, n)).df.select("i", (-F.col("v")).alias("v"))
            own = y.where(row_in(lo, hi)).unionByName(given).groupBy("i").agg(F.sum("v").alias("v"))
            own = own.join(diagonal, "i").select("i", (F.col("v") / F.col("d")).alias("v")) if divided else own
            return checkpoint(y.where(~row_in(lo, hi)).unionByName(own))

        for (lo, hi), part in zip(spans[1:], low[1:], strict=True):
            y = less(y, part, lo, hi, False)
        for (lo, hi), part in zip(spans[::-1], up[::-1], strict=True):
            y = less(y, part, lo, hi, True)
        return checkpoint(y.join(places, F.col("i") == F.col("p")).select(F.col("at").alias("i"), "v"))

    return Both(n, frames, arrays)
