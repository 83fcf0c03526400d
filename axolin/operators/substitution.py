"""Triangular systems by substitution along dependency levels.

A row is free once the rows it depends on are solved; its level is one more than the greatest level of those. The triangle
stays distributed, in packed ranges of consecutive rows. All right-hand sides go side by side.

Up to COLUMNS right-hand sides are solved in strips, of which the driver knows the numbers only: a strip has a range of rows
with their right-hand sides and the columns of the same numbers. A wave is one job for the strips whose sums from earlier
strips are complete: each solves its rows and leaves in the shared checkpoint folder its solution and what that takes from
the rows of each later strip. So every strip is read once, and no vector comes to the driver.

For levels, and for more right-hand sides, up to types.DRIVER_ROWS rows what is known of them (solution or right-hand side,
level) is an array on the driver, so many right-hand sides at a time as make DRIVER_ROWS values. A wave is one job without a
shuffle: every unfinished range gets the arrays and solves its rows in order as far as the rows they depend on are known or
solved in that range before. The first unfinished range always ends, so there are no more waves than ranges, and each value
comes to the driver once. Beyond that number of rows the levels are tables: one join of the edges with the rows just solved
for each level, written to the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from axolin import types
from axolin.plans import blocks
from axolin.plans.blocks import laid_out, to_array
from axolin.plans.loop import checkpoint, folder_ready, stored
from axolin.types import Mat, driver_sized, need


def _parts(a: Mat, kind: str, transposed: bool) -> tuple[DataFrame, bool]:
    """(entries off the diagonal, whether they lie below it) of the triangle that is solved with."""
    need(kind in ("lower", "upper") and a.m == a.n, "a square triangle is needed")
    e = a.df.where(F.col("j") < F.col("i") if kind == "lower" else F.col("j") > F.col("i"))
    if transposed:
        e = e.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return e.select("i", "j", "v"), (kind == "lower") != transposed


def _diagonal(a: Mat) -> DataFrame:
    d = a.df.where("i = j AND v != 0").select("i", "v")
    if d.count() != a.m:
        raise ZeroDivisionError("zero on the diagonal")
    return d


def _ranges(rows: np.ndarray, at: np.ndarray, size: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the entries of the wanted rows of a chunk, and for each the row's place among the wanted ones."""
    k = np.searchsorted(rows, wanted)
    k[k == len(rows)] = 0
    there = np.flatnonzero(rows[k] == wanted) if len(rows) else np.zeros(0, np.int64)
    k = k[there]
    start, stop = at[k], np.append(at, size)[k + 1]
    n = stop - start
    places = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
    return places, np.repeat(there, n)


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One range of rows: their numbers, where their entries begin, columns in 4 bytes, values."""
    i, j, v = pdf["i"].to_numpy(), pdf["j"].to_numpy(np.int32), pdf["v"].to_numpy(float)
    order = np.argsort(i, kind="stable")
    i = i[order]
    at = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    made = i[at].astype(np.int32), at.astype(np.int64), j[order], v[order]
    return pd.DataFrame({"part": pdf["part"][:1], **{name: [x.tobytes()] for name, x in zip(("rows", "at", "cols", "vals"), made, strict=True)}})


def _advance(rows, at, cols, vals, diagonal, x, level, known):
    """(rows, values, levels) that follow from what is known, in the order of the rows."""
    ends, base = np.append(at[1:], len(cols)), int(rows[0])
    # what is solved here, over a copy of the part of the arrays that the range has
    size = int(rows[-1]) - base + 1
    own_x, own_level, own_known = x[base : base + size].copy(), level[base : base + size].copy(), known[base : base + size].copy()
    inside = cols >= base
    outer_open = np.add.reduceat((~known[cols] & ~inside).astype(np.int32), at) > 0
    inner = np.add.reduceat(inside.astype(np.int32), at)
    outer_top = np.maximum.reduceat(np.where(inside, -1, level[cols]), at)
    given = np.where(inside, 0.0, vals)
    outer_sum = np.stack([np.add.reduceat(given * x[cols, k], at) for k in range(x.shape[1])], axis=1) if x.shape[1] else np.zeros((len(rows), 0))
    done = []
    for k in np.flatnonzero(~outer_open & ~known[rows]).tolist():
        r, rest, top = int(rows[k]) - base, outer_sum[k], outer_top[k]
        if inner[k]:
            here = slice(at[k], ends[k])
            there = inside[here]
            c = cols[here][there] - base
            if not own_known[c].all():
                continue
            rest, top = rest + vals[here][there] @ own_x[c], max(top, own_level[c].max())
        own_x[r], own_level[r], own_known[r] = (own_x[r] - rest) / diagonal[r + base], top + 1, True
        done.append(r)
    return np.array(done, np.int64) + base, own_x[done], own_level[done]


def on_arrays(cells: DataFrame, below: bool, diagonal: np.ndarray, right: np.ndarray, few: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(solutions, levels) for entries (i, j, v) off the diagonal and right-hand sides of n rows; a range of rows has some
    `few` entries (blocks.CHUNK by default), or one row."""
    n, width = len(right), max(1, types.DRIVER_ROWS // max(1, len(right)))
    if not below:  # rows and columns from the end
        flip = lambda c: (n - 1 - F.col(c)).alias(c)
        x, level = on_arrays(cells.select(flip("i"), flip("j"), "v"), True, diagonal[::-1], right[::-1], few)
        return x[::-1], level[::-1]
    sc = cells.sparkSession.sparkContext
    counts = to_array(cells.groupBy("i").agg(F.count(F.lit(1)).cast("double").alias("v")), n)
    free = counts == 0
    part_of = (np.cumsum(counts) - 1) // max(1, blocks.CHUNK if few is None else few)
    bounds = np.flatnonzero(np.diff(part_of)) + 1  # rows that begin a range
    part_of = np.searchsorted(bounds, np.arange(n), "right")
    if free.all():
        return right / diagonal[:, None], np.zeros(n, np.int32)

    @F.pandas_udf("int")
    def part(i: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, i.to_numpy(), "right").astype(np.int32))

    ranges = cells.select("i", "j", F.col("v").cast("double").alias("v"), part("i").alias("part")).groupBy("part").applyInPandas(_pack, "part int, rows binary, at binary, cols binary, vals binary")
    ranges = checkpoint(ranges).persist(StorageLevel.MEMORY_AND_DISK)
    shared, out, level = sc.broadcast(diagonal), np.empty(right.shape), np.zeros(n, np.int32)
    for first in range(0, max(1, right.shape[1]), width):
        x = right[:, first : first + width].astype(float)
        x[free] /= diagonal[free][:, None]
        level, known = np.zeros(n, np.int32), free.copy()
        while not known.all():
            # a condition, not a join: each join would leave its table on the driver until that collects its garbage
            left = F.col("part").isin([int(k) for k in np.unique(part_of[~known])])
            sent = sc.broadcast((x, level, known))

            def run(batches, sent=sent, k=x.shape[1]):
                for b in batches:
                    for r in zip(*(c.to_pylist() for c in b.columns[1:5]), strict=True):
                        chunk = [np.frombuffer(c, t) for c, t in zip(r, (np.int32, np.int64, np.int32, float), strict=True)]
                        rows, values, tops = _advance(*chunk, shared.value, *sent.value)
                        yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary()) for z in (rows.astype(np.int32), values, tops)], ["rows", "x", "level"])

            solved = ranges.where(left).select("part", "rows", "at", "cols", "vals").mapInArrow(run, "rows binary, x binary, level binary")
            for r in solved.collect():
                rows = np.frombuffer(r.rows, np.int32)
                x[rows], level[rows], known[rows] = np.frombuffer(r.x).reshape(len(rows), x.shape[1]), np.frombuffer(r.level, np.int32), True
            sent.destroy()
        out[:, first : first + width] = x
    ranges.unpersist()
    shared.destroy()
    return out, level


#: Right-hand sides of a strip.
COLUMNS = 16
#: Blocks of rows among which ranges are cut.
CUTS = 1 << 14
_STRIP = ", ".join(["part int", *[f"{c} binary" for c in ("diagonal", "right", "at", "own_rows", "own_cols", "own_vals", "rows", "cols", "vals", "later")]])
_GIVEN = "part int, rows binary, vals binary"


def _cut(blocks_of_rows: list[tuple[int, int, int]], block: int, few: int, n: int) -> list[int]:
    """The rows that begin a range, for each block's cost, the last row that its columns reach, and the last row after one
    of its rows that no column of the block before it reaches (0: none). A range ends after some `few` in cost, or an eighth
    of it where no column before reaches beyond, so that parts without links stay apart."""
    bounds, so_far, far = [0], 0, 0
    for k, (cost, reach, clear) in enumerate(blocks_of_rows):
        if so_far and so_far + cost > few:
            bounds.append(k * block)
            so_far = 0
        so_far += cost
        if far < clear < n and 8 * so_far >= few:
            bounds.append(clear)
            so_far = cost if clear < (k + 1) * block else 0
        far = max(far, reach)
    return bounds


def _sums_by(rows: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sums of v over them)."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(rows)), bool), rows[1:] != rows[:-1]]))
    return rows[at], np.add.reduceat(v[order], at) if len(at) else v[:0]


def _strip(bounds: np.ndarray, n: int, width: int):
    """Packs one strip of the entries (i, j, v); the right-hand sides are columns from n on."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        lo, hi = int(bounds[part]), int(bounds[part + 1])
        i, j, v = pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["v"].to_numpy(float)
        diagonal, right = np.zeros(hi - lo), np.zeros((hi - lo, width))
        same, side = i == j, j >= n
        np.add.at(diagonal, i[same] - lo, v[same])
        np.add.at(right, (i[side] - lo, j[side] - n), v[side])
        own, later = np.flatnonzero(~same & ~side & (i < hi)), np.flatnonzero(~side & (i >= hi))
        own, later = own[np.argsort(i[own], kind="stable")], later[np.argsort(i[later], kind="stable")]
        at = np.searchsorted(i[own] - lo, np.arange(hi - lo + 1))
        local = lambda k, c: (c[k] - lo).astype(np.int32)
        to = np.unique(np.searchsorted(bounds, i[later], "right") - 1).astype(np.int32)
        made = diagonal, right, at.astype(np.int64), local(own, i), local(own, j), v[own], i[later].astype(np.int64), local(later, j), v[later], to
        return pd.DataFrame({"part": np.array([part], np.int32), **{c.split()[0]: [x.tobytes()] for c, x in zip(_STRIP.split(", ")[1:], made, strict=True)}})

    return pack


def _solved(bounds: np.ndarray, width: int, strip: dict, given: list[tuple[bytes, bytes]]) -> list[tuple[int, bytes, bytes]]:
    """(-1, first row, solution) of a strip, and for each later one (its number, rows, what they lose)."""
    kinds = {"at": np.int64, "own_rows": np.int32, "own_cols": np.int32, "rows": np.int64, "cols": np.int32, "later": np.int32}
    get = {c: np.frombuffer(strip[c], kinds.get(c, float)) for c in (x.split()[0] for x in _STRIP.split(", ")[1:])}
    lo, rest = int(bounds[strip["part"]]), get["right"].reshape(-1, width).copy()
    for rows, vals in given:
        rows = np.frombuffer(rows, np.int64)
        rest[rows - lo] -= np.frombuffer(vals).reshape(len(rows), width)
    at, cols, vals, x = get["at"].tolist(), get["own_cols"], get["own_vals"], rest
    free = np.diff(get["at"]) == 0
    x[free] /= get["diagonal"][free][:, None]
    for r in np.flatnonzero(~free).tolist():
        here = slice(at[r], at[r + 1])
        x[r] = (x[r] - vals[here] @ x[cols[here]]) / get["diagonal"][r]
    out = [(-1, np.array([lo], np.int64).tobytes(), x.tobytes())]
    ends = np.searchsorted(get["rows"], bounds[1:][get["later"]])
    start = 0
    for to, end in zip(get["later"].tolist(), ends.tolist(), strict=True):
        here = slice(start, end)
        rows, sums = _sums_by(get["rows"][here], get["vals"][here, None] * x[get["cols"][here]])
        out.append((to, rows.tobytes(), sums.tobytes()))
        start = end
    return out


def in_strips(entries: DataFrame, right: DataFrame, n: int, width: int, few: int | None = None) -> DataFrame:
    """(i, j, v) of the solution for the entries (i, j, v) of a lower triangle with its diagonal and right-hand sides
    (i, j, v), of which there are `width`; a strip has some `few` entries (blocks.CHUNK by default), or a block of rows."""
    spark, few, block = entries.sparkSession, max(1, blocks.CHUNK if few is None else few), -(-n // CUTS)
    columns = entries.groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("far"), F.max(F.expr("CAST(i = j AND v != 0 AS int)")).alias("full")).withColumn("k", F.expr(f"j div {block}"))
    columns = columns.withColumn("top", F.max("far").over(Window.partitionBy("k").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)))
    clear = F.max(F.when(F.col("top") <= F.col("j"), F.col("j") + 1).otherwise(0))
    seen = columns.groupBy("k").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("full").alias("full"), clear.alias("clear")).orderBy("k").collect()
    if sum(r.full for r in seen) != n:
        raise ZeroDivisionError("zero on the diagonal")
    bounds = np.array([*_cut([(r.n + block * width, r.far, r.clear) for r in seen], block, few, n), n])

    @F.pandas_udf("int")
    def part(i: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(bounds, i.to_numpy(), "right") - 1).astype(np.int32))

    sides = right.select("i", (F.col("j") + n).alias("j"), F.col("v").cast("double").alias("v"), F.col("i").alias("k"))
    cells = entries.select("i", "j", F.col("v").cast("double").alias("v"), F.col("j").alias("k")).unionByName(sides)
    strips = stored(cells.select("i", "j", "v", part("k").alias("part")).groupBy("part").applyInPandas(_strip(bounds, n, width), _STRIP))
    waiting: dict[int, set[int]] = {k: set() for k in range(len(bounds) - 1)}
    for r in strips.select("part", "later").collect():
        for to in np.frombuffer(r.later, np.int32).tolist():
            waiting[to].add(r.part)
    folder, names, waves = f"{folder_ready(spark)}/strips-{uuid.uuid4().hex}", _GIVEN.split(", "), 0
    names = [c.split()[0] for c in names]
    read = lambda: spark.read.schema(_GIVEN).parquet(*[f"{folder}/{k}" for k in range(waves)])

    def alone(frames):
        for pdf in frames:
            for r in pdf.to_dict("records"):
                yield pd.DataFrame(_solved(bounds, width, r, []), columns=names)

    def with_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = pdf["diagonal"].notna()
        given = list(zip(pdf.loc[~whole, "rows"], pdf.loc[~whole, "vals"], strict=True))
        return pd.DataFrame(_solved(bounds, width, pdf[whole].to_dict("records")[0], given), columns=names)

    solved: set[int] = set()
    while waiting:
        ready = [k for k, needs in waiting.items() if needs <= solved]
        mine = F.col("part").isin(ready)
        now = strips.where(mine)
        if waves:
            now = now.unionByName(read().where(mine), allowMissingColumns=True).groupBy("part").applyInPandas(with_sums, _GIVEN)
        else:
            now = now.mapInPandas(alone, _GIVEN)
        now.write.parquet(f"{folder}/{waves}")
        waves += 1
        solved.update(ready)
        for k in ready:
            del waiting[k]

    def cells_of(batches):
        for b in batches:
            for rows, vals in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, lo = np.frombuffer(vals), int(np.frombuffer(rows, np.int64)[0])
                m = len(x) // width
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(lo, lo + m), width)), pa.array(np.tile(np.arange(width), m)), pa.array(x)], ["i", "j", "v"])

    return read().where("part = -1").select("rows", "vals").mapInArrow(cells_of, "i long, j long, v double")


def on_tables(cells: DataFrame, diagonal: DataFrame | None, n: int, right: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """The same with right-hand sides (i, j, v) as a table: (solutions, (i, level))."""
    spark = cells.sparkSession
    cells = checkpoint(cells)
    folder = f"{spark.sparkContext.getCheckpointDir()}/levels-{uuid.uuid4().hex}"
    counts = cells.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    state = checkpoint(spark.range(n).select(F.col("id").alias("i")).join(counts, "i", "left").select("i", F.coalesce("n", F.lit(0)).cast("bigint").alias("waiting"), F.lit(0).alias("level")))
    rest = checkpoint(right.select("i", "j", F.col("v").cast("double").alias("v"))) if right is not None else None
    while True:
        free = state.where("waiting = 0")
        free.select("i", "level").write.mode("append").parquet(f"{folder}/levels")
        edges = cells.join(free.select(F.col("i").alias("j"), F.col("level").alias("l")), "j")
        given = edges.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.max("l").alias("l"))
        if rest is not None:
            solved = checkpoint(rest.join(free.select("i"), "i", "left_semi").join(diagonal.select("i", F.col("v").alias("d")), "i").select("i", "j", (F.col("v") / F.col("d")).alias("v")))
            solved.write.mode("append").parquet(f"{folder}/solutions")
            less = cells.join(solved.select(F.col("i").alias("j"), F.col("j").alias("c"), F.col("v").alias("w")), "j").select("i", F.col("c").alias("j"), (-F.col("v") * F.col("w")).alias("v"))
            rest = checkpoint(rest.join(free.select("i"), "i", "left_anti").unionByName(less).groupBy("i", "j").agg(F.sum("v").alias("v")))
        state = state.where("waiting > 0").join(given, "i", "left")
        state = checkpoint(state.select("i", (F.col("waiting") - F.coalesce("n", F.lit(0))).alias("waiting"), F.greatest("level", F.coalesce(F.col("l") + 1, F.lit(0))).alias("level")))
        if not state.limit(1).count():
            break
    read = lambda name, ddl: spark.read.schema(ddl).parquet(f"{folder}/{name}")
    return read("solutions", "i long, j long, v double") if right is not None else None, read("levels", "i long, level int")


def levels(a: Mat, kind: str = "lower") -> DataFrame:
    """(i, level) of every row of a triangle."""
    cells, below = _parts(a, kind, False)
    if not a.m:
        return a.df.sparkSession.createDataFrame([], "i long, level int")
    if not driver_sized(a.m):
        return on_tables(cells, None, a.m, None)[1]
    _, level = on_arrays(cells, below, np.ones(a.m), np.zeros((a.m, 0)))
    return laid_out(a.df.sparkSession, "i long, level int", a.m, lambda p, q, level: (np.arange(p, q), level[p:q]), level)


#: Passes over the triangle, each with so many right-hand sides as make types.DRIVER_ROWS values.
PASSES = 16


def on_driver(m: int, k: int) -> bool:
    """Whether a column of m rows is an array on the driver, and k of them take at most PASSES passes."""
    return driver_sized(m) and m * max(1, k) <= PASSES * types.DRIVER_ROWS


def substitute(a: Mat, b: Mat, kind: str = "lower", unit: bool = False, transposed: bool = False) -> Mat:
    """X with op(T) X = B for the lower or upper triangle T of A, with a unit diagonal if asked; a zero on the diagonal
    raises. Rows of B without entries are zero; so are those of the table form, which leaves them out."""
    cells, below = _parts(a, kind, transposed)
    need(a.m == b.m, "a fitting right-hand side is needed")
    spark = a.df.sparkSession
    if not a.m:
        return b
    if not on_driver(a.m, b.n):
        ones = spark.range(a.m).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))
        return Mat(on_tables(cells, ones if unit else _diagonal(a), a.m, b.df)[0], b.m, b.n)
    if 0 < b.n <= COLUMNS:
        own = spark.range(a.m).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")) if unit else a.df.where("i = j").select("i", "j", "v")
        turn = lambda c: (F.col(c) if below else a.m - 1 - F.col(c)).cast("bigint").alias(c)
        x = in_strips(cells.unionByName(own).select(turn("i"), turn("j"), "v"), b.df.select(turn("i"), F.col("j").cast("bigint").alias("j"), "v"), a.m, b.n)
        return Mat(x.select(turn("i"), "j", "v"), b.m, b.n)
    diagonal = np.ones(a.m) if unit else to_array(a.df.where("i = j").select("i", "v"), a.m)
    if not diagonal.all():
        raise ZeroDivisionError("zero on the diagonal")
    right = np.zeros((b.m, b.n))
    if b.m * b.n <= types.DRIVER_ROWS:
        got = b.df.select(F.col("i").cast("bigint"), F.col("j").cast("bigint"), F.col("v").cast("double")).toArrow()
        right[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy()
        del got
    else:  # a column at a time, of what is made only once
        sides = stored(b.df.select("i", "j", "v"))
        for k in range(b.n):
            right[:, k] = to_array(sides.where(F.col("j") == k), b.m)
    x, _ = on_arrays(cells, below, diagonal, right)
    del right

    def cells_of(p: int, q: int, x: np.ndarray, k: int = b.n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(np.arange(p, q), k), np.tile(np.arange(k), q - p), x[p:q].ravel()

    return Mat(laid_out(spark, "i long, j long, v double", b.m, cells_of, x), b.m, b.n)


def in_blocks(a: Mat, blocks: int) -> Mat:
    """The diagonal blocks of A, at most ceil(m / blocks) rows each: the levels of all blocks go side by side."""
    size = max(1, -(-a.m // blocks))
    return Mat(a.df.where(F.expr(f"i div {size} = j div {size}")), a.m, a.n)
