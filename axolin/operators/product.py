"""Products as equi-joins on the contraction index followed by grouped sums.

The vector side is broadcast where its length is known to be within types.BROADCAST_ROWS; otherwise both sides are
shuffled by the contraction index and adaptive execution splits skewed indices; spgemm deals heavy indices to several
tasks by itself. Sums combine before they shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axolin.operators.fourier import linear_convolution
from axolin.operators.matrix import gaps
from axolin.operators.vector import axpby, lookup
from axolin.plans.blocks import to_array
from axolin.plans.loop import checkpoint, stored
from axolin.types import Mat, Vec, driver_sized, need, small, spread


def gemv(a: Mat, x: Vec, transposed: bool = False) -> Vec:
    """A x or A^T x; rows without entries have no result row (zero)."""
    need(x.n == (a.m if transposed else a.n), f"lengths differ: {a.m} x {a.n} and {x.n}")
    inner, outer = (F.col("i"), F.col("j")) if transposed else (F.col("j"), F.col("i"))
    y = a.df.join(lookup(x.df, x.n), inner == F.col("key")).groupBy(outer.alias("i")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return Vec(y, a.n if transposed else a.m)


def gemv_axpby(alpha: float, a: Mat, x: Vec, beta: float, y: Vec, transposed: bool = False) -> Vec:
    """alpha A x + beta y."""
    ax = gemv(a, x, transposed)
    need(ax.n == y.n, "lengths differ")
    return Vec(axpby(alpha, ax.df, beta, y.df, sparse=True), y.n)


def outer(x: Vec, y: Vec) -> Mat:
    """x y^T, each row of x against all of y: this product has no key."""
    b = small(y.df.select(F.col("i").alias("j"), F.col("v").alias("w")), y.n)
    return Mat(spread(x.df, x.n, y.n).crossJoin(b).select("i", "j", (F.col("v") * F.col("w")).alias("v")), x.n, y.n)


def ger(a: Mat, alpha: float, x: Vec, y: Vec) -> Mat:
    """A + alpha x y^T, over A's entries and all places that both vectors have. A's entries look up both vectors, and the
    places between them in a row are counted through, so that no place of the dense result is shuffled."""
    need((a.m, a.n) == (x.n, y.n), "shapes differ")
    rows, cols = (small(t.df.select(F.col("i").alias(k), F.col("v").alias(w)), t.n) for t, k, w in ((x, "i", "p"), (y, "j", "q")))
    own = a.df.join(rows, "i", "left").join(cols, "j", "left").select("i", "j", (F.col("v") + F.coalesce(float(alpha) * F.col("p") * F.col("q"), F.lit(0.0))).alias("v"))
    rest = gaps(a, x.df.withColumnRenamed("v", "p")).join(cols, "j").select("i", "j", (float(alpha) * F.col("p") * F.col("q")).alias("v"))
    return Mat(own.unionByName(rest), a.m, a.n)


def multiply(a: Mat, b: Mat) -> Mat:
    """A B entry by entry; results of zero stay as entries."""
    need(a.n == b.m, f"shapes differ: {a.m} x {a.n} and {b.m} x {b.n}")
    right = b.df.select(F.col("i").alias("k"), F.col("j").alias("l"), F.col("v").alias("w"))
    c = a.df.join(right, F.col("j") == F.col("k")).groupBy("i", F.col("l").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return Mat(c, a.m, b.n)


#: Entries that a task sums by row at a time in times_array.
HELD = 4_000_000


def times_array(a: Mat, x: np.ndarray) -> Mat:
    """A X for a few columns X as an array, at most types.DRIVER_ROWS rows of them: every task has X, multiplies the
    entries that it reads and sums by row over HELD of them before anything is shuffled. Nothing is joined, and the driver
    holds the array alone, not a table of its rows."""
    need(a.n == len(x) and driver_sized(len(x)), "lengths differ, or X has too many rows")
    x = x.reshape(len(x), -1)
    k, sent = x.shape[1], a.df.sparkSession.sparkContext.broadcast(x)

    def summed(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(i, kind="stable")
        i, j, v = i[order], j[order], v[order]
        at = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(i[at]), *[pa.array(np.add.reduceat(v * sent.value[j, c], at)) for c in range(k)]], ["i", *[f"v{c}" for c in range(k)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n += b.num_rows
            if n >= HELD:
                yield summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield summed(*(np.concatenate(c) for c in zip(*held, strict=True)))

    cells = a.df.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))
    sums = cells.mapInArrow(run, ", ".join(["i long", *[f"v{c} double" for c in range(k)]])).groupBy("i").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in range(k)])
    return Mat(sums.select("i", F.posexplode(F.array(*[f"v{c}" for c in range(k)])).alias("j", "v")).withColumn("j", F.col("j").cast("bigint")), a.m, k)


#: A contraction index is heavy if it has more than one in so many entries of either factor; fewer than twice as many are.
HEAVY = 64


def spgemm(a: Mat, b: Mat, heavy: int = HEAVY) -> Mat:
    """A B where a few contraction indices may hold much of either factor.

    Entries are counted by contraction index first. Those of a heavy index are dealt to a grid of tasks: A's by row to as
    many shares as they have multiples of 1 / heavy of A, B's by column likewise, and each share of one side meets each
    share of the other. Light indices are joined as they are. Products are summed together.
    """
    need(a.n == b.m, f"shapes differ: {a.m} x {a.n} and {b.m} x {b.n}")
    none = F.lit(0).cast("bigint")
    counts = a.df.select(F.col("j").alias("k"), F.lit(1).cast("bigint").alias("p"), none.alias("q")).unionByName(b.df.select(F.col("i").alias("k"), none.alias("p"), F.lit(1).cast("bigint").alias("q")))
    counts = checkpoint(counts.groupBy("k").agg(F.sum("p").alias("p"), F.sum("q").alias("q")))
    total = counts.agg(F.coalesce(F.sum("p"), none).alias("p"), F.coalesce(F.sum("q"), none).alias("q")).first()
    if not total.p or not total.q:
        return Mat(a.df.limit(0), a.m, b.n)
    shares = lambda c, n: F.ceil(F.col(c) * heavy / n).cast("int")
    few = counts.select("k", F.greatest(F.lit(1), shares("p", total.p)).alias("rows"), F.greatest(F.lit(1), shares("q", total.q)).alias("cols"))
    few = F.broadcast(few.where("rows > 1 OR cols > 1"))  # fewer than 2 * heavy rows
    right = b.df.select(F.col("i").alias("k"), F.col("j").alias("l"), F.col("v").alias("w"))
    left = a.df.select("i", F.col("j").alias("k"), "v")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt_left = left.join(few, "k").select("i", "k", "v", F.pmod(F.xxhash64("i"), "rows").alias("r"), each("cols").alias("c"))
    dealt_right = right.join(few, "k").select("k", "l", "w", each("rows").alias("r"), F.pmod(F.xxhash64("l"), "cols").alias("c"))
    light = left.join(few, "k", "left_anti").join(right.join(few, "k", "left_anti"), "k")
    products = light.select("i", "l", (F.col("v") * F.col("w")).alias("v")).unionByName(dealt_left.join(dealt_right, ["k", "r", "c"]).select("i", "l", (F.col("v") * F.col("w")).alias("v")))
    return Mat(products.groupBy("i", F.col("l").alias("j")).agg(F.sum("v").alias("v")), a.m, b.n)


#: Entries of A in a share of rows; a share makes some 16 times as many products.
SHARE = 1_000_000
#: Products that a task holds at a time, or those of one row.
PIECE = 2_000_000
#: Rows of a product that leave a task at a time.
OUT = 100_000
#: Columns of B of which one packed row may hold entries.
PACKED = 1 << 16


def _multiplied(i, k, v, j, l, w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
    """(row, column, sum) of the products of entries (i, k, v), by row, and (j, l, w), by j."""
    first = np.searchsorted(j, k, "left")
    n = np.searchsorted(j, k, "right") - first
    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    rows, cols, made = np.repeat(i, n), l[at], np.repeat(v, n) * w[at]
    low, left = (int(rows.min()), int(cols.min())) if len(rows) else (0, 0)
    wide = int(cols.max()) - left + 1 if len(rows) else 1
    key = (rows - low) * wide + (cols - left)
    del at, rows, cols
    size = int(key.max()) + 1 if len(key) else 0
    if size <= 4 * len(key):  # nearly dense
        sums, there = np.bincount(key, made, size), np.flatnonzero(np.bincount(key, minlength=size))
        return there // wide + low, there % wide + left, sums[there]
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[start] // wide + low, key[start] % wide + left, np.add.reduceat(made[order], start)


def _packed_rows(b: Mat) -> DataFrame:
    """(k, l, w, o): the rows of B as arrays, by ranges of columns, and whether a value is null. For arrays that is NaN, and a
    column that is null is -1."""
    cells = b.df.select("i", F.coalesce("j", F.lit(-1).cast("bigint")).alias("j"), F.coalesce(F.col("v").cast("double"), F.lit(float("nan"))).alias("v"), F.col("v").isNull().alias("o")).where("i IS NOT NULL")
    packed = cells.repartition("i").groupBy(F.col("i").alias("k"), F.expr(f"j div {PACKED}").alias("piece")).agg(F.collect_list("j").alias("l"), F.collect_list("v").alias("w"), F.max("o").alias("o"))
    return stored(packed.drop("piece"))


def _met(p: pd.DataFrame, q: pd.DataFrame) -> dict[str, np.ndarray]:
    """The entries (i, k, v) by row and (j, l, w) by j of one share."""
    p, q = p.sort_values("i", kind="stable"), q.sort_values("k", kind="stable")
    n = q["l"].map(len).to_numpy()
    kinds = {"i": (p["i"], np.int64), "k": (p["k"], np.int64), "v": (p["v"], float), "j": (np.repeat(q["k"].to_numpy(), n), np.int64), "l": (np.concatenate(q["l"].to_numpy()), np.int64), "w": (np.concatenate(q["w"].to_numpy()), float)}
    return {c: np.asarray(x, t) for c, (x, t) in kinds.items()}


def _pieces(i, k, j) -> Iterator[slice]:
    """Rows of a share's entries (i, k), cut where their products with entries of rows j fill a piece."""
    n = np.searchsorted(j, k, "right") - np.searchsorted(j, k, "left")
    ends = np.flatnonzero(np.append(i[1:] != i[:-1], True)) + 1
    made, start = np.cumsum(n)[ends - 1], 0
    while start < len(i):
        before = made[np.searchsorted(ends, start, "right") - 1] if start else 0
        stop = ends[max(np.searchsorted(made, before + PIECE, "right") - 1, np.searchsorted(ends, start, "right"))]
        yield slice(start, stop)
        start = stop


def _shares(a: Mat, b: Mat, most: int, meet: Callable, ddl: str) -> DataFrame:
    """What meet(whether NaN is null)(p, q) gives for A's entries (i, k, v) and B's packed rows (k, l, w) of every share, of at most so many
    products where rows and columns can be cut so far."""
    none = F.lit(0).cast("bigint")
    packed = _packed_rows(b)
    own = a.df.select(F.coalesce("i", F.lit(-1).cast("bigint")).alias("i"), F.col("j").alias("k"), F.col("v").cast("double").alias("v")).where("j IS NOT NULL")
    counts = own.groupBy("k").agg(F.count(F.lit(1)).alias("p"), none.alias("q"), F.max(F.col("v").isNull()).alias("o")).unionByName(packed.select("k", none.alias("p"), F.size("l").cast("bigint").alias("q"), "o"))
    counts = counts.groupBy("k").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.max("o").alias("o"))
    total = counts.agg(*[F.coalesce(F.sum(c), none).alias(c) for c in ("p", "q")], F.coalesce(F.sum(F.col("p").cast("double") * F.col("q")), F.lit(0.0)).alias("made"), F.max("o").alias("nulls")).first()
    if not total.made:
        return a.df.sparkSession.createDataFrame([], ddl)
    # shares of A's rows, as few as can be, and of B's columns where a share of rows would make too much
    rows = int(min(a.m, -(-total.p // SHARE)))
    cols = int(min(b.n, max(1, -(-total.q // SHARE) if rows == 1 else 1, -(-total.made // (most * rows)))))
    left = own.select(F.expr(f"CAST(i div {-(-a.m // rows)} AS INT)").alias("r"), "i", "k", "v")
    touched = left.select(F.col("r").alias("s"), F.col("k").alias("x")).distinct()
    if cols > 1:  # rows of B are cut where a share of columns ends
        cut = packed.select("k", F.explode(F.arrays_zip("l", "w")).alias("e")).groupBy("k", F.expr(f"CAST(e.l div {-(-b.n // cols)} AS INT)").alias("c"), F.expr(f"e.l div {PACKED}").alias("piece"))
        right = cut.agg(F.collect_list("e.l").alias("l"), F.collect_list("e.w").alias("w")).drop("piece")
        left = left.select("r", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c"), "i", "k", "v")
    else:
        right = packed.select("k", F.lit(0).alias("c"), "l", "w")
        left = left.select("r", F.lit(0).alias("c"), "i", "k", "v")
    right = touched.join(right, F.col("x") == F.col("k")).select(F.col("s").alias("t"), F.col("c").alias("d"), "k", "l", "w")
    return left.groupBy("r", "c").cogroup(right.groupBy("t", "d")).applyInPandas(meet(bool(total.nulls)), ddl)


def spgemm_shares(a: Mat, b: Mat) -> Mat:
    """A B where the products are many more than the entries: they are summed where they are made.

    A is dealt to shares of consecutive rows, and B's columns to shares where one of rows would make too much. B's rows are
    packed once, and a share of rows gets those that its entries touch, so what moves are at most as many entries as there
    are products, and far fewer where rows of A near each other touch the same ones or the contraction indices are few. A
    share multiplies its entries some rows at a time and no sum has a second part elsewhere. As a product is linear, the
    entries of one place may also come in several parts, which need not be summed before.
    """
    need(a.n == b.m, f"shapes differ: {a.m} x {a.n} and {b.m} x {b.n}")

    def meet(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({c: [] for c in "ikvjlw"})
        return pd.DataFrame({c: [x.tobytes()] for c, x in _met(p, q).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                i, k, v, j, l, w = (np.frombuffer(c[row].as_buffer(), t) for c, t in zip(batch.columns, (np.int64, np.int64, float) * 2, strict=True))  # noqa: E741
                for at in _pieces(i, k, j):
                    got = _multiplied(i[at], k[at], v[at], j, l, w)
                    made_here = pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["i", "j", "v"])
                    yield from (made_here.slice(at, OUT) for at in range(0, made_here.num_rows, OUT))

    met = _shares(a, b, 16 * SHARE, lambda _: meet, ", ".join(f"{c} binary" for c in "ikvjlw"))
    made = met.mapInArrow(run, "i long, j long, v double")
    return Mat(made.select(*[F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in "ij"], "v"), a.m, b.n)


#: Contraction indices of a share up to which its rows are summed up from dense blocks of products.
FEW_INDICES = 16
#: Cells of such a block.
BLOCK_CELLS = 1 << 18


def _rows_of_blocks(i, k, v, j, l, w) -> tuple[np.ndarray, ...] | None:  # noqa: E741
    """As _rows_of_products, for finite values and few contraction indices; None for others."""
    ks, cols = np.unique(j), np.unique(l)
    if len(ks) > FEW_INDICES or len(ks) * len(cols) > 4 * len(j) or not (np.isfinite(v).all() and np.isfinite(w).all()):
        return None
    here = np.isin(k, ks)
    i, k, v = i[here], np.searchsorted(ks, k[here]), v[here]
    right, there = np.zeros((len(ks), len(cols))), np.zeros((len(ks), len(cols)), bool)
    at = np.searchsorted(ks, j), np.searchsorted(cols, l)
    np.add.at(right, at, w)
    there[at] = True
    rows, i = np.unique(i, return_inverse=True)
    left, bits = np.zeros((len(rows), len(ks))), np.zeros((len(rows), len(ks)), bool)
    np.add.at(left, (i, k), v)
    bits[i, k] = True
    entries, top, total = np.zeros(len(rows), np.int64), np.zeros(len(rows)), left @ right.sum(axis=1)
    # rows that have the same indices have their entries in the same columns
    kinds, of = np.unique(bits, axis=0, return_inverse=True)
    for n, kind in enumerate(kinds):
        mine, has = np.flatnonzero(of.ravel() == n), there[kind].any(axis=0)
        some = right if has.all() else np.ascontiguousarray(right[:, has])
        entries[mine], step = has.sum(), max(1, BLOCK_CELLS // max(1, some.shape[1]))
        block = np.empty((step, some.shape[1]))
        for x in range(0, len(mine), step):
            part = left[mine[x : x + step]]
            top[mine[x : x + step]] = np.matmul(part, some, out=block[: len(part)]).max(axis=1)
    return rows, entries, total, top, np.ones(len(rows), bool)


def _rows_of_products(i, k, v, j, l, w, nulls: bool) -> tuple[np.ndarray, ...]:  # noqa: E741
    """(row, entries, total, top, whether these two have a value) of the product of entries (i, k, v), by row, and (j, l, w),
    by j. With nulls a factor of NaN is one without a value: it makes a place, and adds nothing to its sum."""
    lost = nulls and (np.isnan(v).any() or np.isnan(w).any())
    r, c, x = _multiplied(i, k, np.nan_to_num(v, nan=0.0, posinf=np.inf, neginf=-np.inf) if lost else v, j, l, np.nan_to_num(w, nan=0.0, posinf=np.inf, neginf=-np.inf) if lost else w)
    if not len(r):
        return r, r, x, x, np.zeros(0, bool)
    known = _multiplied(i, k, (~np.isnan(v)).astype(float), j, l, (~np.isnan(w)).astype(float))[2] > 0 if lost else np.ones(len(r), bool)
    at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    return r[at], np.diff(np.append(at, len(r))), np.add.reduceat(np.where(known, x, 0.0), at), np.maximum.reduceat(np.where(known, x, -np.inf), at), np.maximum.reduceat(known, at)


#: Products of a share of which only rows' sums leave the task.
SUMMED = 1 << 33


def product_rows(a: Mat, b: Mat) -> DataFrame:
    """(i, entries, total, top) of the rows of A B: how many entries each has, their sum and the largest. Shares as in
    spgemm_shares make all entries and sum them up there, so that none leaves its task. A null index of a row or column
    counts as one, a null value adds nothing."""
    need(a.n == b.m, f"shapes differ: {a.m} x {a.n} and {b.m} x {b.n}")
    names = ["i", "entries", "total", "top", "known"]

    def meet(nulls: bool, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({c: [] for c in names})
        i, k, v, j, l, w = _met(p, q).values()  # noqa: E741
        got = [_rows_of_blocks(i, k, v, j, l, w)]
        if got[0] is None:
            got = [_rows_of_products(i[at], k[at], v[at], j, l, w, nulls) for at in _pieces(i, k, j)]
        return pd.DataFrame(dict(zip(names, (np.concatenate(c) for c in zip(*got, strict=True)), strict=True)))

    parts = _shares(a, b, SUMMED, lambda nulls: partial(meet, nulls), "i long, entries long, total double, top double, known boolean")
    # NaN comes back as null
    value = lambda c: F.when(F.col("known"), F.coalesce(c, F.lit(float("nan"))))
    sums = parts.groupBy("i").agg(F.sum("entries").alias("entries"), F.sum(value("total")).alias("total"), F.max(value("top")).alias("top"))
    return sums.withColumn("i", F.when(F.col("i") >= 0, F.col("i")))


def gemm(a: Mat, b: Mat, alpha: float = 1.0, beta: float = 0.0, c: Mat | None = None, trans_a: bool = False, trans_b: bool = False) -> Mat:
    """alpha op(A) op(B) + beta C."""
    p = multiply(a.T if trans_a else a, b.T if trans_b else b)
    if c is None:
        return p if alpha == 1 else Mat(p.df.withColumn("v", F.col("v") * float(alpha)), p.m, p.n)
    need((p.m, p.n) == (c.m, c.n), "shapes differ")
    return Mat(axpby(alpha, p.df, beta, c.df, sparse=True), p.m, p.n)


def blocked(a: Mat, size: int) -> DataFrame:
    """(bi, bj, data): dense blocks of size x size in row-major order."""
    cell = (F.pmod(F.col("i"), F.lit(size)) * size + F.pmod(F.col("j"), F.lit(size))).cast("int")
    groups = a.df.select(F.expr(f"i div {size}").cast("int").alias("bi"), F.expr(f"j div {size}").cast("int").alias("bj"), cell.alias("c"), "v").groupBy("bi", "bj")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.zeros(size * size)
        d[pdf["c"]] = pdf["v"]
        return pd.DataFrame({"bi": pdf["bi"][:1], "bj": pdf["bj"][:1], "data": [d]})

    return groups.applyInPandas(fill, "bi int, bj int, data array<double>")


_BLOCK = "bi int, bj int, data array<double>"


def _blocks(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    at = list(sums)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in at], pa.int32()), pa.array([k[1] for k in at], pa.int32()), pa.array([sums[k] for k in at], pa.list_(pa.float64()))], ["bi", "bj", "data"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each run of blocks of one place."""
    last, held = None, None
    for b in batches:
        cells = b.column("data").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else []
        for at, d in zip(zip(b.column("bi").to_pylist(), b.column("bj").to_pylist(), strict=True), cells, strict=True):
            if at == last:
                held += d
                continue
            if last is not None:
                yield _blocks({last: held})
            last, held = at, d.copy()
    if last is not None:
        yield _blocks({last: held})


def gemm_blocks(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """The product of blocked matrices: block pairs meet by join, numpy multiplies them, partial blocks are summed."""

    @F.pandas_udf("array<double>")
    def times(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([(np.asarray(p).reshape(size, size) @ np.asarray(q).reshape(size, size)).ravel() for p, q in zip(x, y, strict=True)])

    right = b.select(F.col("bi").alias("k"), F.col("bj").alias("l"), F.col("data").alias("other"))
    parts = a.join(right, F.col("bj") == F.col("k")).select("bi", F.col("l").alias("bj"), times("data", "other").alias("data"))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums the blocks of one place as they come; a task has the places of its batches."""
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            cells = b.column("data").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for at, d in zip(zip(b.column("bi").to_pylist(), b.column("bj").to_pylist(), strict=True), cells, strict=True):
                if at in sums:
                    sums[at] += d
                else:
                    sums[at] = d.copy()
                if len(sums) * d.size > 1 << 25:  # 256 MB
                    yield _blocks(sums)
                    sums = {}
        if sums:
            yield _blocks(sums)

    # partial sums in the tasks of the join, then whole ones: combined before and after the shuffle
    return parts.mapInArrow(total, _BLOCK).repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(_runs, _BLOCK)


def from_blocks(blocks: DataFrame, size: int, m: int, n: int) -> Mat:
    e = blocks.select("bi", "bj", F.posexplode("data").alias("c", "v"))
    e = e.select((F.col("bi").cast("bigint") * size + F.expr(f"c div {size}")).alias("i"), (F.col("bj").cast("bigint") * size + F.col("c") % size).alias("j"), "v")
    return Mat(e.where((F.col("i") < m) & (F.col("j") < n)), m, n)


def galerkin(p: Mat, a: Mat) -> Mat:
    """P^T A P."""
    return multiply(p.T, multiply(a, p))


def structured(e: Vec, kind: str) -> Mat:
    """The entries of a circulant, toeplitz, hankel or vandermonde matrix; a toeplitz or hankel matrix of n rows has
    2 n - 1 parameters."""
    need(kind in ("circulant", "toeplitz", "hankel", "vandermonde"), "unknown kind")
    need(kind in ("circulant", "vandermonde") or e.n % 2 == 1, "2 n - 1 parameters are needed")
    n = e.n if kind in ("circulant", "vandermonde") else (e.n + 1) // 2
    all_ = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    entries = spread(e.df, e.n, n)
    if kind == "vandermonde":
        return Mat(entries.select("i", all_.alias("j"), "v").select("i", "j", F.pow("v", F.col("j").cast("double")).alias("v")), n, n)
    # every parameter knows its places: j runs, and i follows from it
    i = {"circulant": F.pmod(F.col("k") + F.col("j"), F.lit(n).cast("bigint")), "toeplitz": F.col("k") + F.col("j") - (n - 1), "hankel": F.col("k") - F.col("j")}[kind]
    cells = entries.select(F.col("i").alias("k"), all_.alias("j"), "v").select(i.alias("i"), "j", "v")
    return Mat(cells.where((F.col("i") >= 0) & (F.col("i") < n)), n, n)


def _part(y: DataFrame, start: int, n: int) -> Vec:
    return Vec(y.where((F.col("i") >= start) & (F.col("i") < start + n)).select((F.col("i") - start).alias("i"), "v"), n)


def circulant(e: Vec, x: Vec) -> Vec:
    """Entries (i, j) are e[(i - j) mod n]: a convolution, folded."""
    need(e.n == x.n, "lengths differ")
    y = linear_convolution(e.df, e.n, x.df, x.n)
    return Vec(y.groupBy(F.pmod("i", F.lit(x.n).cast("bigint")).alias("i")).agg(F.sum("v").alias("v")), x.n)


def toeplitz(e: Vec, x: Vec) -> Vec:
    """Entries (i, j) are e[n - 1 + i - j]: 2 n - 1 parameters, from the upper right corner to the lower left one; the
    product is the middle part of a convolution."""
    need(e.n == 2 * x.n - 1, "2 n - 1 parameters are needed")
    return _part(linear_convolution(e.df, e.n, x.df, x.n), x.n - 1, x.n)


def hankel(e: Vec, x: Vec) -> Vec:
    """Entries (i, j) are e[i + j]: the same with x reversed."""
    need(e.n == 2 * x.n - 1, "2 n - 1 parameters are needed")
    return _part(linear_convolution(e.df, e.n, x.df.select((x.n - 1 - F.col("i")).alias("i"), "v"), x.n), x.n - 1, x.n)


#: Coefficients of a polynomial that one row holds.
COEFFICIENTS = 4096


def vandermonde(e: Vec, x: Vec) -> Vec:
    """Entries (i, j) are e[i] ** j: polynomials at the points e, by Horner's rule. Coefficients that fit the driver go to
    the tasks as an array; a task takes its points side by side. More of them stay a table, in arrays of COEFFICIENTS."""
    if not driver_sized(x.n):
        return _vandermonde_table(e, x)
    # as in a sum of products, a coefficient without a value adds nothing
    sent = e.df.sparkSession.sparkContext.broadcast(to_array(x.df.where("i IS NOT NULL AND v IS NOT NULL"), x.n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("e").to_numpy(zero_copy_only=False)
            v = np.full(len(at), sent.value[-1])
            with np.errstate(all="ignore"):
                for c in sent.value[-2::-1]:
                    v *= at
                    v += c
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(v, mask=b.column("e").is_null().to_numpy(zero_copy_only=False))], ["i", "v"])

    points = spread(e.df.select(F.col("i").cast("bigint").alias("i"), F.col("v").cast("double").alias("e")), e.n, x.n)
    return Vec(points.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")), e.n)


def _vandermonde_table(e: Vec, x: Vec) -> Vec:
    at = F.expr(f"{COEFFICIENTS - 1} - i % {COEFFICIENTS}").cast("int")
    parts = x.df.groupBy(F.expr(f"i div {COEFFICIENTS}").alias("part")).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "v"))).alias("c"))
    step = lambda acc, c: F.struct((acc["v"] * F.pow(F.col("e"), (c["at"] - acc["at"]).cast("double")) + c["v"]).alias("v"), c["at"].alias("at"))
    value = F.aggregate("c", F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("at")), step)
    rows = e.df.select("i", F.col("v").alias("e")).crossJoin(small(parts, -(-x.n // COEFFICIENTS) * COEFFICIENTS))
    low = value["v"] * F.pow(F.col("e"), (COEFFICIENTS - 1 - value["at"]).cast("double")) * F.pow(F.col("e"), (F.col("part") * COEFFICIENTS).cast("double"))
    return Vec(rows.groupBy("i").agg(F.sum(low).alias("v")), e.n)


def convolve(x: Vec, y: Vec) -> Vec:
    """Circular convolution of equal lengths."""
    return circulant(x, y)
