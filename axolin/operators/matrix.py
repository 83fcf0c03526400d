"""Matrix operators on DataFrames (i, j, v): structure, views, norms and dense fill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axolin.plans.blocks import to_array
from axolin.types import Mat, Vec, driver_sized, need, small, spread


def row(a: Mat, k: int) -> Vec:
    need(0 <= k < a.m, "row outside the matrix")
    return Vec(a.df.where(F.col("i") == k).select(F.col("j").alias("i"), "v"), a.n)


def column(a: Mat, k: int) -> Vec:
    need(0 <= k < a.n, "column outside the matrix")
    return Vec(a.df.where(F.col("j") == k).select("i", "v"), a.m)


def diagonal(a: Mat, k: int = 0) -> Vec:
    """Entries with j - i = k, numbered from 0."""
    size = max(0, min(a.m + min(k, 0), a.n - max(k, 0)))
    return Vec(a.df.where(F.col("j") - F.col("i") == k).select(F.least(F.col("i"), F.col("j")).alias("i"), "v"), size)


def from_diagonal(x: Vec, k: int = 0) -> Mat:
    """A square matrix of size n + |k| with x on its k-th diagonal."""
    return Mat(x.df.select((F.col("i") + max(-k, 0)).alias("i"), (F.col("i") + max(k, 0)).alias("j"), "v"), x.n + abs(k), x.n + abs(k))


def set_diagonal(a: Mat, value: float) -> Mat:
    """a with value on the whole diagonal, also where a has no entry."""
    size = min(a.m, a.n)
    diag = a.df.sparkSession.range(size).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(float(value)).alias("v"))
    return Mat(a.df.where(F.col("i") != F.col("j")).unionByName(diag), a.m, a.n)


def part(a: Mat, r0: int, r1: int, c0: int, c1: int) -> Mat:
    need(0 <= r0 <= r1 <= a.m and 0 <= c0 <= c1 <= a.n, "range outside the matrix")
    inside = (F.col("i") >= r0) & (F.col("i") < r1) & (F.col("j") >= c0) & (F.col("j") < c1)
    return Mat(a.df.where(inside).select((F.col("i") - r0).alias("i"), (F.col("j") - c0).alias("j"), "v"), r1 - r0, c1 - c0)


def strided(a: Mat, rows: tuple[int, int, int], cols: tuple[int, int, int]) -> Mat:
    """(start, stride, size) for rows and columns."""
    out = a.df
    for c, (start, stride, size), n in (("i", rows, a.m), ("j", cols, a.n)):
        need(stride > 0 and start >= 0 and (size == 0 or start + stride * (size - 1) < n), "slice outside the matrix")
        off = F.col(c) - start
        out = out.where((off >= 0) & (off % stride == 0) & (off < stride * size)).withColumn(c, F.expr(f"({c} - {start}) div {stride}"))
    return Mat(out, rows[2], cols[2])


def lower(a: DataFrame) -> DataFrame:
    return a.where(F.col("j") <= F.col("i"))


def upper(a: DataFrame) -> DataFrame:
    return a.where(F.col("j") >= F.col("i"))


def diagonal_block(a: DataFrame, start: int, stop: int) -> DataFrame:
    return a.where((F.col("i") >= start) & (F.col("i") < stop) & (F.col("j") >= start) & (F.col("j") < stop)).select((F.col("i") - start).alias("i"), (F.col("j") - start).alias("j"), "v")


def row_info(a: Mat) -> DataFrame:
    """(i, norm_inf, norm_1, norm_2, diag) of every row, zeros for empty ones."""
    got = a.df.groupBy("i").agg(F.max(F.abs(F.col("v"))).alias("norm_inf"), F.sum(F.abs(F.col("v"))).alias("norm_1"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm_2"), F.max(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("diag"))
    grid = a.df.sparkSession.range(a.m).select(F.col("id").alias("i"))
    return grid.join(got, "i", "left").select("i", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in got.columns[1:]])


def row_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.sum("v").alias("v"))


def column_sums(a: DataFrame) -> DataFrame:
    return a.groupBy(F.col("j").alias("i")).agg(F.sum("v").alias("v"))


def frobenius(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v"))


#: Places of a gap that one row counts through, so that no task holds a long sequence for each of its rows.
RUN = 4096


def gaps(a: Mat, rows: DataFrame) -> DataFrame:
    """The given rows (i, ...) with each column j where a has no entry: from each entry of a row to the next one."""
    known = a.df.groupBy("i").agg(F.sort_array(F.collect_list("j")).alias("js"))
    one = F.lit(1).cast("bigint")
    ends = F.concat(F.array(-one), F.coalesce("js", F.array().cast("array<bigint>")), F.array(F.lit(a.n).cast("bigint")))
    laid = spread(rows.join(known, "i", "left").withColumn("ends", ends).drop("js"), a.m, a.n)
    pairs = F.arrays_zip(F.slice("ends", F.lit(1), F.size("ends") - 1).alias("lo"), F.slice("ends", F.lit(2), F.size("ends") - 1).alias("hi"))
    spans = laid.withColumn("gap", F.explode(F.filter(pairs, lambda g: g["hi"] - g["lo"] > 1))).drop("ends")
    spans = spans.withColumn("lo", F.col("gap.lo") + 1).withColumn("hi", F.col("gap.hi") - 1).drop("gap")
    runs = spans.withColumn("from", F.explode(F.sequence("lo", "hi", F.lit(RUN).cast("bigint"))))
    return runs.withColumn("j", F.explode(F.sequence("from", F.least("hi", F.col("from") + (RUN - 1))))).drop("from", "lo", "hi")


def dense(a: Mat) -> Mat:
    """a with explicit zeros: its entries, and zeros in the gaps of each row, of which none is shuffled."""
    if not a.n:
        return Mat(a.df.limit(0), a.m, a.n)
    zeros = gaps(a, a.df.sparkSession.range(a.m).select(F.col("id").alias("i"))).select("i", "j", F.lit(0.0).alias("v"))
    return Mat(a.df.select("i", "j", F.col("v").cast("double").alias("v")).unionByName(zeros), a.m, a.n)


def row_arrays(a: DataFrame) -> DataFrame:
    """(i, entries): each row's (j, v) in order of j."""
    return a.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("entries"))


def from_row_arrays(rows: DataFrame) -> DataFrame:
    """(i, j, v) of (i, entries); padding (negative j) is dropped."""
    return rows.select("i", F.explode("entries").alias("e")).select("i", "e.j", "e.v").where("j >= 0")


def ell(a: DataFrame) -> DataFrame:
    """Rows padded to the longest row, which one row of one number tells."""
    rows = row_arrays(a)
    width = rows.agg(F.max(F.size("entries")).alias("width"))
    pad = F.struct(F.lit(-1).cast("bigint").alias("j"), F.lit(0.0).alias("v"))
    return rows.join(F.broadcast(width)).select("i", F.concat("entries", F.array_repeat(pad, F.col("width") - F.size("entries"))).alias("entries"))


def sliced_ell(a: DataFrame, height: int = 32) -> DataFrame:
    """(slice, i, entries): rows padded to the longest of their slice of `height` rows."""
    rows = row_arrays(a).withColumn("slice", F.expr(f"i div {height}"))
    width = rows.groupBy("slice").agg(F.max(F.size("entries")).alias("width"))
    pad = F.struct(F.lit(-1).cast("bigint").alias("j"), F.lit(0.0).alias("v"))
    return rows.join(width, "slice").select("slice", "i", F.concat("entries", F.array_repeat(pad, F.col("width") - F.size("entries"))).alias("entries"))


def hybrid(a: Mat, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(rows cut to a width, entries beyond it): the least width that covers that share of all rows entirely.

    The width comes from a histogram of row lengths, which has a row for each different length.
    """
    rows = row_arrays(a.df).withColumn("n", F.size("entries"))
    sizes = sorted((r.n, r.c) for r in rows.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect())
    covered, width = a.m - sum(c for _, c in sizes), 0
    for n, c in sizes:
        if covered >= share * a.m:
            break
        covered, width = covered + c, n
    front = rows.select("i", F.slice("entries", 1, width).alias("entries")) if width else rows.select("i", F.filter("entries", lambda e: F.lit(False)).alias("entries"))
    rest = rows.where(F.col("n") > width).select("i", F.explode(F.expr(f"slice(entries, {width + 1}, greatest(n - {width}, 0))")).alias("e"))
    return front, rest.select("i", "e.j", "e.v")


def from_csr(spark, row_jumper: list[int], columns: list[int], values: list[float]) -> DataFrame:
    """(i, j, v) from raw arrays: row i has the places row_jumper[i] .. row_jumper[i + 1] - 1."""
    need(len(columns) == len(values) == row_jumper[-1], "lengths differ")
    entries = spark.createDataFrame([(k, int(c), float(v)) for k, (c, v) in enumerate(zip(columns, values, strict=True))], "k bigint, j bigint, v double")
    spans = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(row_jumper, row_jumper[1:], strict=False)) if b > a], "i bigint, a bigint, b bigint")
    return spans.select("i", F.explode(F.sequence("a", F.col("b") - 1)).alias("k")).join(entries, "k").select("i", "j", "v")


def entry_positions(a: DataFrame) -> DataFrame:
    """Row pointers of the compressed form: (i, n) for non-empty rows."""
    return a.groupBy("i").agg(F.count(F.lit(1)).alias("n"))


def top_per_row(a: DataFrame, p: int) -> DataFrame:
    """The p entries of largest magnitude in each row, smaller j first on ties."""
    from pyspark.sql import Window

    w = Window.partitionBy("i").orderBy(F.abs(F.col("v")).desc(), "j")
    return a.withColumn("r", F.row_number().over(w)).where(F.col("r") <= p).drop("r")


def merge_rows(a: DataFrame, b: DataFrame, alpha: float = 1.0) -> DataFrame:
    """a + alpha b over the union of both patterns."""
    return a.unionByName(b.withColumn("v", F.col("v") * alpha)).groupBy("i", "j").agg(F.sum("v").alias("v"))


def permute(a: DataFrame, p: DataFrame, n: int | None = None) -> DataFrame:
    """Entry (i, j) moves to (p(i), p(j)); p is (i, p), broadcast if its number of rows is given and within the bound."""
    rows = small(p.select(F.col("i").alias("a"), F.col("p").alias("pa")), n)
    cols = small(p.select(F.col("i").alias("b"), F.col("p").alias("pb")), n)
    return a.join(rows, F.col("i") == F.col("a")).join(cols, F.col("j") == F.col("b")).select(F.col("pa").alias("i"), F.col("pb").alias("j"), "v")


def bandwidth(a: DataFrame) -> DataFrame:
    return a.agg(F.max(F.abs(F.col("i") - F.col("j"))).alias("bandwidth"))


def bandwidths(a: Mat, p: DataFrame) -> DataFrame:
    """(before, after): the bandwidths of A and of A in the order of the places (i, p). Places that fit the driver go to the
    tasks as an array of 4 bytes each, so that no table of them is made for a join there."""
    if not driver_sized(a.n):
        return bandwidth(a.df).toDF("before").crossJoin(bandwidth(permute(a.df, p)).toDF("after"))
    sent = a.df.sparkSession.sparkContext.broadcast(to_array(p.select("i", F.col("p").alias("v")), a.n).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                i, j = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                yield pa.RecordBatch.from_arrays([pa.array([int(np.abs(x - y).max())]) for x, y in ((i, j), (sent.value[i].astype(np.int64), sent.value[j]))], ["before", "after"])

    cells = a.df.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"))
    return cells.mapInArrow(run, "before long, after long").agg(F.max("before").alias("before"), F.max("after").alias("after"))
