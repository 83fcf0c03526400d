"""All eigenvalues and vectors of a symmetric matrix by two-sided block rotations.

The matrix is a table of dense blocks. In a round of a tournament every block index has one partner; each pair's diagonal
square (two blocks wide) is diagonalised in its own task, and its rotation is applied to the rows and columns of both
blocks: every square of a pair of rows and a pair of columns is one group, so a round is two jobs and no task holds more
than four blocks and two rotations. After all rounds of a tournament every pair has met once. What is off the diagonal
falls with each tournament, at the end by its square.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axolin.plans.loop import checkpoint
from axolin.types import Mat, need

_BLOCK = "p int, q int, data binary"


def tournament(n: int) -> list[list[tuple[int, int]]]:
    """Rounds of disjoint pairs (p < q) in which each two of n meet once; with an odd n one rests in each round."""
    ring = list(range(n + n % 2))
    out = []
    for _ in range(len(ring) - 1):
        pairs = [(min(x), max(x)) for x in zip(ring[: len(ring) // 2], ring[::-1], strict=False)]
        out.append([x for x in pairs if x[1] < n])
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def _blocks(a: Mat, size: int) -> DataFrame:
    count = -(-a.n // size)
    cells = a.df.select(F.expr(f"CAST(i div {size} AS INT)").alias("p"), F.expr(f"CAST(j div {size} AS INT)").alias("q"), F.expr(f"CAST(i % {size} * {size} + j % {size} AS INT)").alias("at"), "v")
    # every block has a row, also one without entries
    spark = a.df.sparkSession
    places = spark.range(count * count).select(F.expr(f"CAST(id div {count} AS INT)").alias("p"), F.expr(f"CAST(id % {count} AS INT)").alias("q"), F.lit(0).alias("at"), F.lit(0.0).alias("v"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.zeros(size * size)
        np.add.at(d, pdf["at"].to_numpy(), pdf["v"].to_numpy())
        return pd.DataFrame({"p": pdf["p"][:1], "q": pdf["q"][:1], "data": [d.tobytes()]})

    return cells.unionByName(places).groupBy("p", "q").applyInPandas(fill, _BLOCK)


def _square(pdf: pd.DataFrame, rows: list[int], cols: list[int], size: int) -> np.ndarray:
    x = np.zeros((len(rows) * size, len(cols) * size))
    for p, q, data in zip(pdf["p"], pdf["q"], pdf["data"], strict=True):
        r, c = rows.index(p) * size, cols.index(q) * size
        x[r : r + size, c : c + size] = np.frombuffer(data).reshape(size, size)
    return x


def _cut_up(x: np.ndarray, rows: list[int], cols: list[int], size: int) -> pd.DataFrame:
    cells = [(p, q, np.ascontiguousarray(x[r * size : (r + 1) * size, c * size : (c + 1) * size]).tobytes()) for r, p in enumerate(rows) for c, q in enumerate(cols)]
    return pd.DataFrame(cells, columns=["p", "q", "data"])


def _rotations(pairs: list[tuple[int, ...]], size: int):
    """The rotation that diagonalises a pair's square."""

    def rotate(pdf: pd.DataFrame) -> pd.DataFrame:
        pair = list(pairs[int(pdf["pair"].iloc[0])])
        x = _square(pdf, pair, pair, size)
        _, v = np.linalg.eigh((x + x.T) / 2)
        return pd.DataFrame({"pair": pdf["pair"][:1], "turn": [np.ascontiguousarray(v).tobytes()]})

    return rotate


def eigen(a: Mat, size: int = 256, tol: float = 1e-13, most: int = 30, vectors: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """((k, value) descending, (i, k, v) if asked) of a symmetric matrix, in blocks of `size` rows."""
    need(a.m == a.n, "a square matrix is needed")
    spark, n = a.df.sparkSession, a.n
    count = -(-n // size)
    # rows that fill the last block get values above all others, so that nothing mixes with them
    bound = a.df.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s")).first()[0] or 0.0
    filled = spark.range(n, count * size).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(2.0 * bound + 1.0).alias("v"))
    state = checkpoint(_blocks(Mat(a.df.select("i", "j", "v").unionByName(filled), count * size, count * size), size))
    basis = checkpoint(_blocks(Mat(spark.range(count * size).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), count * size, count * size), size)) if vectors else None

    def norms(pdf_iter):
        for pdf in pdf_iter:
            out = []
            for p, q, data in zip(pdf["p"], pdf["q"], pdf["data"], strict=True):
                x = np.frombuffer(data).reshape(size, size)
                y = x - np.diag(np.diag(x)) if p == q else x
                out.append((float((x * x).sum()), float((y * y).sum())))
            yield pd.DataFrame(out, columns=["whole", "off"])

    def turn(df: DataFrame, pairs: list[tuple[int, int]], turns: DataFrame, rows_too: bool) -> DataFrame:
        """df with its columns, and its rows if asked, rotated."""
        of = {x: k for k, pair in enumerate(pairs) for x in pair}
        number = F.create_map(*[F.lit(v) for kv in of.items() for v in kv])
        left = turns.select(F.col("pair").alias("rp"), F.col("turn").alias("rt")) if rows_too else None
        tagged = df.withColumn("cp", number[F.col("q")]).withColumn("rp", number[F.col("p")] if rows_too else F.col("p"))
        tagged = tagged.join(turns.select(F.col("pair").alias("cp"), F.col("turn").alias("ct")), "cp")
        tagged = tagged.join(left, "rp") if rows_too else tagged.withColumn("rt", F.lit(None).cast("binary"))

        def apply(pdf: pd.DataFrame) -> pd.DataFrame:
            cols = list(pairs[int(pdf["cp"].iloc[0])])
            rows = list(pairs[int(pdf["rp"].iloc[0])]) if rows_too else [int(pdf["p"].iloc[0])]
            x = _square(pdf, rows, cols, size) @ np.frombuffer(pdf["ct"].iloc[0]).reshape(len(cols) * size, -1)
            if rows_too:
                x = np.frombuffer(pdf["rt"].iloc[0]).reshape(len(rows) * size, -1).T @ x
            return _cut_up(x, rows, cols, size)

        return checkpoint(tagged.groupBy("rp", "cp").applyInPandas(apply, _BLOCK))

    rounds = tournament(count) if count > 1 else [[(0,)]]
    for _ in range(most):
        whole, off = state.mapInPandas(norms, "whole double, off double").agg(F.sum("whole"), F.sum("off")).first()
        if off <= tol * tol * whole:
            break
        for pairs in rounds:
            pairs = pairs + [(k,) for k in range(count) if not any(k in x for x in pairs)]  # one that rests is alone
            of = {x: k for k, pair in enumerate(pairs) for x in pair}
            number = F.create_map(*[F.lit(v) for kv in of.items() for v in kv])

            own = state.withColumn("pair", number[F.col("p")]).where(F.col("pair") == number[F.col("q")])
            turns = checkpoint(own.groupBy("pair").applyInPandas(_rotations(pairs, size), "pair int, turn binary"))
            state = turn(state, pairs, turns, True)
            basis = turn(basis, pairs, turns, False) if vectors else None

    def diagonal(pdf_iter):
        for pdf in pdf_iter:
            for p, data in zip(pdf["p"], pdf["data"], strict=True):
                yield pd.DataFrame({"at": np.arange(p * size, (p + 1) * size), "value": np.diag(np.frombuffer(data).reshape(size, size))})

    found = state.where("p = q").mapInPandas(diagonal, "at long, value double").toPandas()  # n values, and those that fill the last block
    found = found.sort_values(["value", "at"], ascending=[False, True]).iloc[count * size - n :]
    values = spark.createDataFrame(pd.DataFrame({"k": np.arange(n, dtype=np.int32), "value": found["value"].to_numpy()}), "k int, value double")
    if not vectors:
        return values, None
    ranks = spark.createDataFrame(pd.DataFrame({"at": found["at"].to_numpy(), "k": np.arange(n, dtype=np.int32)}), "at long, k int")

    def cells(pdf_iter):
        for pdf in pdf_iter:
            for p, q, data in zip(pdf["p"], pdf["q"], pdf["data"], strict=True):
                i, j = np.indices((size, size))
                yield pd.DataFrame({"i": i.ravel() + p * size, "at": j.ravel() + q * size, "v": np.frombuffer(data)})

    table = basis.mapInPandas(cells, "i long, at long, v double").where(F.col("i") < n)
    return values, table.join(F.broadcast(ranks), "at").select("i", "k", "v")
