"""Sources and sinks: MatrixMarket files, generators, and exchange with Python, numpy and pandas."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axolin.types import LOCAL_ENTRIES, Mat, Vec, need


def read_matrix_market(spark: SparkSession, path: str, index_base: int = 1) -> Mat:
    """A coordinate file, real, complex (the imaginary part is ignored) or pattern (entries are 1), general or symmetric.

    Only header and size line come to the driver; entries are parsed in parallel. Where a place occurs twice, the later
    line counts. Other formats and unreadable headers raise ValueError.
    """
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    head = lines.where("value like '%MatrixMarket%'").orderBy("n").limit(1).collect()
    need(bool(head), "no MatrixMarket header")
    words = head[0].value.lower().split()
    need(len(words) >= 5 and words[0] == "%%matrixmarket" and words[1] == "matrix" and words[2] == "coordinate", f"unsupported header: {head[0].value}")
    field, symmetry = words[3], words[4]
    need(field in ("real", "integer", "double", "complex", "pattern") and symmetry in ("general", "symmetric"), f"unsupported header: {head[0].value}")
    body = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = body.orderBy("n").limit(1).collect()
    need(bool(size), "no size line")
    m, n = (int(x) for x in size[0].value.split()[:2])
    part = F.split(F.trim("value"), r"\s+")
    value = F.lit(1.0) if field == "pattern" else part[2].cast("double")
    e = body.where(F.col("n") > size[0].n).select((part[0].cast("bigint") - index_base).alias("i"), (part[1].cast("bigint") - index_base).alias("j"), value.alias("v"), "n")
    if symmetry == "symmetric":
        e = e.unionByName(e.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v", "n"))
    return Mat(e.groupBy("i", "j").agg(F.max_by("v", "n").alias("v")), m, n)


def write_matrix_market(a: Mat, path: str, index_base: int = 1) -> None:
    """A folder with one general coordinate file, entries by row and column."""
    spark = a.df.sparkSession
    entries = a.df.count()
    head = spark.createDataFrame([(-2, -1, "%%MatrixMarket matrix coordinate real general"), (-1, -1, f"{a.m} {a.n} {entries}")], "i bigint, j bigint, value string")
    body = a.df.select("i", "j", F.concat_ws(" ", (F.col("i") + index_base).cast("string"), (F.col("j") + index_base).cast("string"), F.col("v").cast("string")).alias("value"))
    head.unionByName(body).orderBy("i", "j").select("value").coalesce(1).write.mode("errorifexists").text(path)


def unit_vector(spark: SparkSession, n: int, k: int) -> Vec:
    return Vec(spark.range(n).select(F.col("id").alias("i"), (F.col("id") == k).cast("double").alias("v")), n)


def scalar_vector(spark: SparkSession, n: int, value: float) -> Vec:
    return Vec(spark.range(n).select(F.col("id").alias("i"), F.lit(float(value)).alias("v")), n)


def zero_vector(spark: SparkSession, n: int) -> Vec:
    return scalar_vector(spark, n, 0.0)


def _hash_uniform(seed: int, *columns: str):
    """A uniform number in (0, 1) that depends on the index and the seed alone, not on partitions."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *columns)), 1, 13), 16, 10).cast("bigint").cast("double")
    return (h + 0.5) / F.lit(float(2**52))


def uniform_vector(spark: SparkSession, n: int, seed: int = 0) -> Vec:
    return Vec(spark.range(n).select(F.col("id").alias("i"), _hash_uniform(seed, "id").alias("v")), n)


def normal_vector(spark: SparkSession, n: int, mean: float = 0.0, deviation: float = 1.0, seed: int = 0) -> Vec:
    """Box-Muller over two hashed uniforms."""
    z = F.sqrt(-2 * F.ln(_hash_uniform(2 * seed, "id"))) * F.cos(2 * np.pi * _hash_uniform(2 * seed + 1, "id"))
    return Vec(spark.range(n).select(F.col("id").alias("i"), (z * deviation + mean).alias("v")), n)


def scalar_matrix(spark: SparkSession, m: int, n: int, value: float) -> Mat:
    cols = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    return Mat(spark.range(m).select(F.col("id").alias("i"), cols.alias("j")).withColumn("v", F.lit(float(value))), m, n)


def zero_matrix(spark: SparkSession, m: int, n: int) -> Mat:
    return scalar_matrix(spark, m, n, 0.0)


def identity_matrix(spark: SparkSession, n: int) -> Mat:
    return Mat(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), n, n)


def laplace_2d(spark: SparkSession, px: int, py: int) -> Mat:
    """The five-point stencil on a px x py grid: 4 on the diagonal, -1 for neighbours; row = x + y px."""
    x, y = F.col("id") % px, F.expr(f"id div {px}")
    point = lambda ok, j, v: F.when(ok, F.struct(j.alias("j"), F.lit(v).alias("v")))
    i = F.col("id")
    cells = F.array(point(F.lit(True), i, 4.0), point(x > 0, i - 1, -1.0), point(x < px - 1, i + 1, -1.0), point(y > 0, i - px, -1.0), point(y < py - 1, i + px, -1.0))
    e = spark.range(px * py).select(i.alias("i"), F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("e"))
    return Mat(e.select("i", "e.j", "e.v"), px * py, px * py)


def diffusion_2d(cells: DataFrame, px: int, py: int) -> Mat:
    """The five-point operator of a px x py grid whose cell x + y px conducts as v > 0 in cells (i, v): neighbours are
    joined by the harmonic mean of both, and cells at the edge to the outside by their own value."""
    x, y, i = F.col("i") % px, F.expr(f"i div {px}"), F.col("i")
    ways = F.array(F.when(x > 0, i - 1), F.when(x < px - 1, i + 1), F.when(y > 0, i - px), F.when(y < py - 1, i + px))
    ends = cells.select(i, F.col("v").cast("double").alias("c"), F.explode(ways).alias("j"))
    other = cells.select(F.col("i").alias("j"), F.col("v").cast("double").alias("d"))
    links = ends.join(other, "j", "left").select("i", "j", F.coalesce(2 * F.col("c") * F.col("d") / (F.col("c") + F.col("d")), F.col("c")).alias("w"))
    diagonal = links.groupBy("i").agg(F.sum("w").alias("v")).select("i", F.col("i").alias("j"), "v")
    return Mat(links.where("j IS NOT NULL").select("i", "j", (-F.col("w")).alias("v")).unionByName(diagonal), px * py, px * py)


def vector_from(spark: SparkSession, values: Iterable[float]) -> Vec:
    rows = [(k, float(v)) for k, v in enumerate(values)]
    return Vec(spark.createDataFrame(rows, "i bigint, v double"), len(rows))


def matrix_from(spark: SparkSession, data, keep_zeros: bool = False) -> Mat:
    """From nested lists, a numpy array, or a list of {column: value} maps with (m, n) read off the rows."""
    if len(data) and isinstance(data[0], dict):
        rows = [(i, int(j), float(v)) for i, r in enumerate(data) for j, v in r.items()]
        return Mat(spark.createDataFrame(rows, "i bigint, j bigint, v double"), len(data), 1 + max((j for _, j, _ in rows), default=-1))
    a = np.asarray(data, float)
    i, j = np.indices(a.shape) if keep_zeros else (None, None)
    i, j = (i.ravel(), j.ravel()) if keep_zeros else np.nonzero(a)
    rows = list(zip(i.tolist(), j.tolist(), a[i, j].tolist(), strict=True))
    return Mat(spark.createDataFrame(rows, "i bigint, j bigint, v double"), *a.shape)


def matrix_from_arrays(df: DataFrame, row: str, values: str, m: int, n: int) -> Mat:
    """From rows with an array of n values each."""
    return Mat(df.select(F.col(row).cast("bigint").alias("i"), F.posexplode(values).alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v")), m, n)


def to_numpy(x: Vec | Mat) -> np.ndarray:
    """A dense array on the driver; refused beyond types.LOCAL_ENTRIES cells."""
    cells = x.n if isinstance(x, Vec) else x.m * x.n
    need(cells <= LOCAL_ENTRIES, f"{cells} cells are too many for the driver")
    got = x.df.toPandas()
    out = np.zeros(x.n if isinstance(x, Vec) else (x.m, x.n))
    if isinstance(x, Vec):
        out[got["i"].to_numpy(int)] = got["v"]
    else:
        out[got["i"].to_numpy(int), got["j"].to_numpy(int)] = got["v"]
    return out


def show(x: Vec | Mat, rows: int = 20) -> None:
    x.df.orderBy(*[c for c in x.df.columns if c != "v"]).show(rows)
