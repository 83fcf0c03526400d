"""Relational encodings of vectors and matrices, with their shapes.

A vector is a DataFrame (i BIGINT, v DOUBLE) with unique i; a matrix is (i BIGINT, j BIGINT, v DOUBLE) with unique
(i, j), where absent entries are zero. The wrappers hold a DataFrame and a shape, no data; shapes are checked here, so
that a mismatch is a ValueError before anything runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many rows of 16 bytes a vector of known length is broadcast (32 MB).
BROADCAST_ROWS = 2_000_000
#: Vectors of at most so many entries may live on the driver within a loop (16 MB); longer ones stay DataFrames.
DRIVER_ROWS = 2_000_000
#: Up to so many entries a matrix may be gathered into one task or the driver, for algorithms that are sequential.
LOCAL_ENTRIES = 4_000_000


def small(df: DataFrame, rows: int | None) -> DataFrame:
    """df, marked for broadcast if its known number of rows is within the bound."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


#: Cells that one task makes of a dense result, if there are that many.
TASK_CELLS = 1 << 24


def spread(df: DataFrame, rows: int, each: int) -> DataFrame:
    """df dealt out to tasks that make some TASK_CELLS cells, `each` from a row; small tables stay as they are."""
    parts = min(rows, -(-rows * each // TASK_CELLS))
    return df.repartition(parts) if parts > 1 else df


def driver_sized(n: int) -> bool:
    return n <= DRIVER_ROWS


def need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Vec:
    """A vector of length n."""

    df: DataFrame
    n: int

    @staticmethod
    def of(df: DataFrame, index: str, value: str, n: int) -> Vec:
        return Vec(df.select(F.col(index).cast("bigint").alias("i"), F.col(value).cast("double").alias("v")), n)


@dataclass(frozen=True)
class Mat:
    """A matrix of m rows and n columns."""

    df: DataFrame
    m: int
    n: int

    @staticmethod
    def of(df: DataFrame, row: str, col: str, value: str, m: int, n: int) -> Mat:
        """Entries summed over repeated (row, col)."""
        e = df.groupBy(F.col(row).cast("bigint").alias("i"), F.col(col).cast("bigint").alias("j"))
        return Mat(e.agg(F.sum(F.col(value).cast("double")).alias("v")), m, n)

    @property
    def T(self) -> Mat:  # noqa: N802
        return Mat(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.n, self.m)
