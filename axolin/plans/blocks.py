"""Packed matrices for loops whose vectors fit the driver.

An iterative method does little with a vector but multiply it. Where vectors have at most types.DRIVER_ROWS entries, a
loop keeps them as arrays on the driver and the matrix stays where it is: in chunks of at most CHUNK entries, packed
once by row, checkpointed and cached. A product is one job without join or shuffle; a vector goes out with the tasks
and comes back as sums by row. Longer vectors take the DataFrame forms of the same methods.
"""

from __future__ import annotations

import pickle
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from axolin.plans.loop import checkpoint
from axolin.types import Mat, Vec, driver_sized, need

CHUNK = 1_000_000
#: A matrix of at most so many entries (coarse grids) is multiplied where the vectors are.
FEW = 20_000
Apply = Callable[[np.ndarray], np.ndarray]


def _packed(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> tuple[bytes, ...]:
    order = np.lexsort((j, i))
    i, j, v = i[order], j[order], v[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(i)), bool), i[1:] != i[:-1]]))
    return i[at].tobytes(), at.astype(np.int64).tobytes(), j.tobytes(), v.tobytes()


def _pack_pattern(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of entries (i, j) without values, their columns in 4 bytes."""
    return _pack(batches, True)


def _pack(batches: Iterator[pa.RecordBatch], pattern: bool = False) -> Iterator[pa.RecordBatch]:
    names, held, n = ["rows", "at", "cols", "vals"], [], 0

    def emit() -> pa.RecordBatch:
        i, j, *v = (np.concatenate([h[k] for h in held]) for k in range(2 if pattern else 3))
        got = _packed(i.astype(np.int64), j, v[0] if v else np.zeros(len(i), bool))
        got = (*got[:3], b"") if pattern else got
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in got], names)

    for b in batches:
        for k in range(0, b.num_rows, CHUNK):
            part = b.slice(k, CHUNK)
            if held and n + part.num_rows > CHUNK:
                yield emit()
                held, n = [], 0
            held.append([c.to_numpy(zero_copy_only=False) for c in part.columns])
            n += part.num_rows
    if n:
        yield emit()


def row_most(rows: np.ndarray, at: np.ndarray, cols: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, greatest x among the columns of its entries)."""
    return rows, np.maximum.reduceat(x[cols], at)


def row_sums(rows: np.ndarray, at: np.ndarray, cols: np.ndarray, vals: np.ndarray, x: np.ndarray, transposed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(index, sums): what the entries of a chunk give to the product with x. Row rows[k] has the entries from at[k] on."""
    w = vals if x.ndim == 1 else vals[:, None]
    if not transposed:
        return rows, np.add.reduceat(w * x[cols], at)
    w = w * x[np.repeat(rows, np.diff(np.append(at, len(cols))))]
    order = np.argsort(cols, kind="stable")
    sorted_ = cols[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return sorted_[starts], np.add.reduceat(w[order], starts)


class Few:
    """A matrix of few entries on the driver."""

    def __init__(self, a: Mat):
        got = a.df.select("i", "j", "v").toPandas()
        self.m, self.n = a.m, a.n
        raw = _packed(got["i"].to_numpy(np.int64), got["j"].to_numpy(np.int64), got["v"].to_numpy(float))
        self.parts = [np.frombuffer(x, t) for x, t in zip(raw, (np.int64, np.int64, np.int64, float), strict=True)]

    def _sums(self, x: np.ndarray, transposed: bool) -> np.ndarray:
        y = np.zeros((self.n if transposed else self.m, *x.shape[1:]), x.dtype)
        *at, vals = self.parts
        if len(vals):
            rows, sums = row_sums(*at, vals.astype(x.dtype, copy=False), x, transposed)
            y[rows] = sums
        return y

    def times(self, x: np.ndarray) -> np.ndarray:
        return self._sums(x, False)

    def times_t(self, x: np.ndarray) -> np.ndarray:
        return self._sums(x, True)

    def release(self) -> None:
        pass

    def each(self, fn: Callable, *arrays: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        return [fn(*self.parts, *arrays)] if len(self.parts[3]) else []

    def most(self, x: np.ndarray) -> np.ndarray:
        y = np.full(self.m, -1, x.dtype)
        if len(self.parts[0]):
            rows, top = row_most(*self.parts[:3], x)
            y[rows] = top
        return y


def packed(a: Mat, pattern: bool = False) -> Chunks | Few:
    """A matrix ready for products with arrays; its pattern only if asked, for `each`."""
    return Few(a) if a.df.limit(FEW + 1).count() <= FEW else Chunks(a, pattern=pattern)


class Chunks:
    """A matrix in packed chunks; times and times_t multiply arrays of one or more columns, in the type of the array."""

    def __init__(self, a: Mat, chunk: int | None = None, pattern: bool = False):
        cells = a.df.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))
        if pattern:
            need(max(a.m, a.n) < 1 << 31, "too many rows or columns")
            cells = a.df.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))
        self.kinds = (np.int64, np.int64, np.int32 if pattern else np.int64, float)
        parts = max(1, -(-cells.count() // (chunk or CHUNK)))
        cells = cells.coalesce(1) if parts == 1 else cells.repartition(parts, "i")
        self.m, self.n = a.m, a.n
        self.df = checkpoint(cells.mapInArrow(_pack_pattern if pattern else _pack, "rows binary, at binary, cols binary, vals binary")).persist(StorageLevel.MEMORY_AND_DISK)

    def _sums(self, x: np.ndarray, transposed: bool) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for rows, at, cols, vals in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    rows, at, cols, vals = (np.frombuffer(c, t) for c, t in ((rows, np.int64), (at, np.int64), (cols, np.int64), (vals, float)))
                    out.append(tuple(z.tobytes() for z in row_sums(rows, at, cols, vals.astype(x.dtype, copy=False), x, transposed)))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.binary()) for k in (0, 1)], ["rows", "sums"])

        y = np.zeros((self.n if transposed else self.m, *x.shape[1:]), x.dtype)
        for r in self.df.mapInArrow(run, "rows binary, sums binary").collect():
            rows = np.frombuffer(r.rows, np.int64)
            y[rows] += np.frombuffer(r.sums, x.dtype).reshape(len(rows), *x.shape[1:])
        return y

    def times(self, x: np.ndarray) -> np.ndarray:
        return self._sums(x, False)

    def times_t(self, x: np.ndarray) -> np.ndarray:
        return self._sums(x, True)

    def each(self, fn: Callable, *arrays: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """The arrays that fn(rows, at, cols, vals, *arrays) makes of every chunk, in one job."""
        kinds, sent = self.kinds, self.df.sparkSession.sparkContext.broadcast(arrays)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [pickle.dumps(fn(*(np.frombuffer(c, t) for c, t in zip(r, kinds, strict=True)), *sent.value)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["made"])

        got = [pickle.loads(r.made) for r in self.df.mapInArrow(run, "made binary").collect()]
        sent.destroy()
        return got

    def most(self, x: np.ndarray) -> np.ndarray:
        """For each row the greatest x among the columns of its entries, -1 without one; x is not negative."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [row_most(*(np.frombuffer(c, np.int64) for c in r[:3]), x) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([o[k].tobytes() for o in out], pa.binary()) for k in (0, 1)], ["rows", "top"])

        y = np.full(self.m, -1, x.dtype)
        for r in self.df.mapInArrow(run, "rows binary, top binary").collect():
            rows = np.frombuffer(r.rows, np.int64)
            y[rows] = np.maximum(y[rows], np.frombuffer(r.top, x.dtype))
        return y

    def release(self) -> None:
        self.df.unpersist()


_kept: OrderedDict = OrderedDict()


def kept(key: object, make: Callable):
    """What make() returned for this key before in the same Python worker, if it is one of the last eight."""
    if key not in _kept:
        _kept[key] = make()
        while len(_kept) > 8:
            _kept.popitem(last=False)
    _kept.move_to_end(key)
    return _kept[key]


class BlockMaps:
    """Maps of disjoint index ranges, one pickled object a row (key, start, stop, data), whose call maps the range's part
    of a vector. All of them are applied in one job."""

    def __init__(self, df: DataFrame, name: str):
        self.df, self.name = checkpoint(df).persist(StorageLevel.MEMORY_AND_DISK), name

    def __call__(self, x: np.ndarray) -> np.ndarray:
        name = self.name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = b.to_pylist()
                parts = [kept((name, r["key"]), lambda r=r: pickle.loads(r["data"]))(x[r["start"] : r["stop"]]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r["start"] for r in rows], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["start", "part"])

        y = np.zeros(len(x))
        for r in self.df.mapInArrow(run, "start long, part binary").collect():
            part = np.frombuffer(r.part, float)
            y[r.start : r.start + len(part)] = part
        return y


#: Rows of a table that go out from the driver as one.
PIECE = 1 << 16


def to_table(spark, ddl: str, *columns: np.ndarray) -> DataFrame:
    """A table of arrays of equal length. They leave the driver as bytes, a row for PIECE of theirs, and become rows in the
    tasks: as rows of Python objects they would take some ten times their size there."""
    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = [{"long": np.int64, "int": np.int32, "double": np.float64}[c.split()[1]] for c in ddl.split(", ")]
    columns = [np.ascontiguousarray(c, k) for c, k in zip(columns, kinds, strict=True)]
    n = len(columns[0])
    if n <= PIECE:
        return spark.createDataFrame(pd.DataFrame(dict(zip(names, columns, strict=True))), ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c, k)) for c, k in zip(r, kinds, strict=True)], names)

    pieces = [tuple(bytearray(c[k : k + PIECE].tobytes()) for c in columns) for k in range(0, n, PIECE)]
    return spark.createDataFrame(pieces, ", ".join(f"{x} binary" for x in names)).mapInArrow(run, ddl)


def laid_out(spark, ddl: str, n: int, fn: Callable, *arrays: np.ndarray) -> DataFrame:
    """A table of the columns that fn(start, stop, *arrays) makes of each range of PIECE of n places. The arrays go out as
    one broadcast and become rows in the tasks, so places, and what else follows from them, are never on the driver."""
    sent, names = spark.sparkContext.broadcast(arrays), [c.split()[0] for c in ddl.split(", ")]
    kinds = [{"long": np.int64, "int": np.int32, "double": np.float64}[c.split()[1]] for c in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                made = fn(k * PIECE, min(n, (k + 1) * PIECE), *sent.value)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, t)) for c, t in zip(made, kinds, strict=True)], names)

    return spark.range(-(-n // PIECE)).mapInArrow(run, ddl)


def to_frame(spark, x: np.ndarray) -> DataFrame:
    """(i, v) of an array."""
    return to_table(spark, "i long, v double", np.arange(len(x)), x)


def to_array(df: DataFrame, n: int) -> np.ndarray:
    """An array of a vector (i, v) of at most types.DRIVER_ROWS entries."""
    got, out = df.select(F.col("i").cast("bigint"), F.col("v").cast("double")).toArrow(), np.zeros(n)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out


def on_arrays(op, spark, n: int) -> Apply:
    """A matrix, or a map of DataFrames (i, v), as a map of arrays of n entries. Maps with a form for arrays, in their
    attribute `arrays`, are applied by it."""
    if isinstance(op, Mat):
        return packed(op).times
    return getattr(op, "arrays", None) or (lambda x: to_array(op(to_frame(spark, x)), n))


class Both:
    """A linear map with a form for DataFrames and one for arrays (None where vectors are too long for that)."""

    def __init__(self, n: int, frames: Callable[[DataFrame], DataFrame], arrays: Callable[[], Apply]):
        self.frames = frames
        self._make, self._arrays, self.n = arrays, None, n

    @property
    def arrays(self) -> Apply | None:
        if self._arrays is None and driver_sized(self.n):
            self._arrays = self._make()
        return self._arrays

    def __call__(self, x: DataFrame) -> DataFrame:
        return self.frames(x)


def as_vec(spark, x: np.ndarray) -> Vec:
    return Vec(to_frame(spark, x), len(x))
