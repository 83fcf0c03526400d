"""Whitening of embeddings: principal components of the different vectors, every row projected and scaled to variance 1.

Entries are turned into integers first, x = floor(SCALE * entry), so that sums, means and deviations are exact whatever
the order in which Spark adds. The fit list has each different x once (equal vectors meet by hash, after being combined
where they lie). Its rows are centred exactly, n x - S as integers, and then divided by n; MLlib's RowMatrix makes their
Gram matrix in one tree aggregation over the executors. Only that matrix (d x d, d at most MAX_DIMENSIONS) is taken to the
driver and decomposed there. Sums, components and eigenvalues are broadcast (their size is d * d doubles at most), and
mapInPandas projects all rows. A second Gram matrix, of the whitened fit list, shows how far it is from the identity.

Defined results: rows whose vector is null or has a null or non-finite entry are dropped; shorter vectors are read as if
zeros followed, up to the longest one (an empty vector is all zeros); entries beyond a long saturate; rows that repeat an
id, and rows without one, are rows of their own; equal vectors count once in the fit and each gets its result; a
component without variance (one vector, or fewer independent ones than components) gets null for whitened, and does
not count in identity_error, which is null if there is no other; explained is null if nothing varies; deviation is null
where it exceeds a long; no rows, or only empty vectors, give no result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from axolin.llm.common import cut, quoted, table

SCALE, COMPONENTS = 256, 4
#: The Gram matrix of so many dimensions has 128 MB.
MAX_DIMENSIONS = 4096


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) of every entry as long."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, lambda c: odd(c.cast("double")))


def covariance(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """The Gram matrix of centred rows (arrays of double), divided by n."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


@dataclass(frozen=True)
class Whitening:
    """n vectors with the sums s, their components as columns, eigenvalues, and the trace of their covariance."""

    n: int
    s: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    largest: int

    def centred(self, x: pd.Series) -> np.ndarray:
        """n x - s, exactly: as long where the sum of squares fits one, else as integers of Python."""
        d = len(self.s)
        fits = (2 * self.n * self.largest) ** 2 * max(d, 1) < 2**63
        rows = np.zeros((len(x), d), np.int64 if fits else object)
        for k, v in enumerate(x):
            rows[k, : len(v)] = v if fits else [int(e) for e in v]
        return rows * self.n - np.array(self.s, rows.dtype)

    def scaled(self, centred: np.ndarray) -> np.ndarray:
        """The projections of centred rows, divided by their standard deviations; NaN where there is none."""
        e = self.eigenvalues
        firm = e > 0
        out = (centred.astype(np.float64) / self.n) @ self.components
        return np.where(firm, out / np.sqrt(np.where(firm, e, 1.0)), np.nan)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of different vectors x (arrays of long, of one length), or None if it has no rows or no
    dimensions."""
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.max(F.array_max("x")).alias("high"), F.min(F.array_min("x")).alias("low")).first()
    n, d = facts["n"], facts["d"] or 0
    if not n or not d:
        return None
    largest = max(abs(facts["high"]), abs(facts["low"]), 1)
    kind = "bigint" if 2 * n * largest < 2**63 else "decimal(38,0)"
    sums = vectors.select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.sum(F.col("x").cast(kind)).alias("s")).collect()  # d rows
    s = [0] * d
    for r in sums:
        s[r["k"]] = int(r["s"])
    total = F.array(*[F.lit(str(v)).cast(kind) for v in s])
    centred = F.zip_with("x", total, lambda x, t: (x.cast(kind) * F.lit(str(n)).cast(kind) - t).cast("double") / F.lit(float(n)))
    v = covariance(vectors.select(centred.alias("y")), "y", n)
    values, basis = np.linalg.eigh(v)
    k = min(components, d)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    floor = d * np.finfo(float).eps * max(values[0], 0.0)
    return Whitening(n, s, np.ascontiguousarray(basis), np.where(values > floor, values, 0.0), float(np.trace(v)), largest)


def whiten(df: DataFrame, name: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(name, component, n, deviation, whitened, explained, identity_error) for each usable row and each component."""
    spark = df.sparkSession
    good = df.where(usable(quoted(vector)))
    d = good.agg(F.max(F.size(quoted(vector)))).first()[0] or 0
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors may have {MAX_DIMENSIONS} dimensions at most")
    filled = F.concat(integers(quoted(vector), scale), F.array_repeat(F.lit(0).cast("bigint"), F.lit(d) - F.size(quoted(vector))))
    rows = good.select(quoted(name).alias("name"), filled.alias("x"))
    different = cut(rows.select("x").distinct())
    found = fit(different, components)
    schema = StructType([StructField(name, df.schema[name].dataType), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType())])
    if found is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(found)
    k = len(found.eigenvalues)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w = shared.value.scaled(shared.value.centred(pdf["x"]))
            yield pd.DataFrame({"w": list(np.nan_to_num(w))})

    white = cut(different.mapInPandas(own, "w array<double>"))
    mean = white.agg(*[F.avg(F.col("w")[c]) for c in range(k)]).first()
    white = white.select(F.zip_with("w", F.array(*[F.lit(m) for m in mean]), lambda w, m: w - m).alias("y"))
    firm = found.eigenvalues > 0
    off = np.abs(covariance(white, "y", found.n) - np.eye(k))[np.ix_(firm, firm)]
    error = float(off.max()) if off.size else None
    explained = found.eigenvalues / found.trace if found.trace > 0 else np.full(k, np.nan)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shared.value
        for pdf in batches:
            centred = of.centred(pdf["x"])
            deviation = [int(v) if v < 2**63 else None for v in (centred * centred).sum(axis=1)] if len(pdf) else []
            w = of.scaled(centred)
            out = {name: np.repeat(pdf["name"].to_numpy(dtype=object), k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(pdf)), "n": np.int64(of.n)}
            out |= {"deviation": pd.array(np.repeat(np.array(deviation, object), k), "Int64"), "whitened": w.ravel(), "explained": np.tile(explained, len(pdf)), "identity_error": error}
            made = pd.DataFrame(out)
            yield made.astype({c: object for c in ("whitened", "explained", "identity_error")}).where(made.notna(), None)

    return rows.mapInPandas(project, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the first four whitened components of every usable vector."""
    return whiten(table(spark, sf_dir, "embeddings"))
