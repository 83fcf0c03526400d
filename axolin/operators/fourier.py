"""Discrete Fourier transforms of complex vectors (batch, k, re, im), and circular convolution.

Forward transforms have sign -1 and no factor; inverse ones have sign +1 and the factor 1 / n. One batch is one grouped
call, of at most types.LOCAL_ENTRIES entries; batches run side by side. One long signal is transformed over many tasks
by long_fft, as columns and rows of a rectangle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axolin.plans.loop import checkpoint
from axolin.types import LOCAL_ENTRIES, need

_OUT = "batch long, k long, re double, im double"


def _mapped(x: DataFrame, change) -> DataFrame:
    most = x.groupBy("batch").count().agg(F.max("count")).first()[0] or 0
    need(most <= LOCAL_ENTRIES, f"a batch has {most} entries")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros(int(pdf["k"].max()) + 1, complex)
        z[pdf["k"].to_numpy(int)] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        y = change(z)
        return pd.DataFrame({"batch": int(pdf["batch"].iloc[0]), "k": np.arange(len(y)), "re": y.real, "im": y.imag})

    return x.groupBy("batch").applyInPandas(run, _OUT)


def fft(x: DataFrame) -> DataFrame:
    return _mapped(x, np.fft.fft)


def ifft(x: DataFrame) -> DataFrame:
    return _mapped(x, np.fft.ifft)


def dft(x: DataFrame, n: int, sign: int = -1) -> DataFrame:
    """The transform by its definition, as a join-free expansion and a grouped sum; for short vectors."""
    angle = F.lit(sign * 2 * np.pi) * ((F.col("k") * F.col("f")) % n) / n
    terms = x.select("batch", "k", "re", "im", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("f"))
    re = F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)
    im = F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)
    return terms.groupBy("batch", F.col("f").alias("k")).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def _chirp(z: np.ndarray) -> np.ndarray:
    n = len(z)
    k = np.arange(n, dtype=np.int64)
    w = np.exp(-1j * np.pi * (k * k % (2 * n)) / n)
    m = 1 << (2 * n - 1).bit_length()
    b = np.zeros(m, complex)
    b[:n] = w.conj()
    b[m - n + 1 :] = w[1:][::-1].conj()
    return w * np.fft.ifft(np.fft.fft(z * w, m) * np.fft.fft(b))[:n]


def bluestein(x: DataFrame) -> DataFrame:
    """The transform of any length as a convolution with a chirp."""
    return _mapped(x, _chirp)


def fft2(x: DataFrame, inverse: bool = False) -> DataFrame:
    """(i, j, re, im): transforms of all rows, then of all columns."""
    one = ifft if inverse else fft
    rows = one(x.select(F.col("i").alias("batch"), F.col("j").alias("k"), "re", "im"))
    cols = one(rows.select(F.col("k").alias("batch"), F.col("batch").alias("k"), "re", "im"))
    return cols.select(F.col("k").alias("i"), F.col("batch").alias("j"), "re", "im")


def convolve(x: DataFrame, y: DataFrame, n: int) -> DataFrame:
    """Circular convolution of each batch, by way of both spectra."""
    a, b = fft(x), fft(y).select("batch", "k", F.col("re").alias("c"), F.col("im").alias("d"))
    p = a.join(b, ["batch", "k"]).select("batch", "k", (F.col("re") * F.col("c") - F.col("im") * F.col("d")).alias("re"), (F.col("re") * F.col("d") + F.col("im") * F.col("c")).alias("im"))
    return ifft(p)


#: Cells of a rectangle that one task holds.
TASK_CELLS = 1 << 20
_CELLS = "p long, q long, re double, im double"


def _sides(n: int) -> tuple[int, int]:
    """n = n1 n2 with n1 <= n2 as near to each other as can be."""
    n1 = next(k for k in range(int(n**0.5), 0, -1) if n % k == 0)
    return n1, n // n1


def long_fft(x: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """(k, re, im): the transform of one signal (k, re, im) of n entries, absent ones zero.

    With n = n1 n2 the signal is a rectangle: its n2 columns are transformed, turned by powers of the n-th root of unity,
    and then its n1 rows; tasks hold TASK_CELLS cells or one column. Lengths without divisors near their root go through
    a convolution with a chirp (long_chirp).
    """
    n1, n2 = _sides(n)
    if n2 > max(TASK_CELLS, 64 * n1) and n > TASK_CELLS:
        return long_chirp(x, n, inverse)
    wide, tall = max(1, TASK_CELLS // max(1, n1)), max(1, TASK_CELLS // n2)
    transform = (lambda z, axis: np.fft.ifft(z, axis=axis)) if inverse else (lambda z, axis: np.fft.fft(z, axis=axis))
    sign = 2j if inverse else -2j

    def filled(pdf: pd.DataFrame, first: int, shape: tuple[int, int], by_row: bool) -> np.ndarray:
        z = np.zeros(shape, complex)
        p, q = pdf["p"].to_numpy(), pdf["q"].to_numpy()
        z[(p - first, q) if by_row else (p, q - first)] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        return z

    def columns(key, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0]) * wide
        count = min(wide, n2 - first)
        z = transform(filled(pdf, first, (n1, count), False), 0)
        p, q = np.indices(z.shape)
        z *= np.exp(sign * np.pi * ((p * (q + first)) % n) / n)
        return pd.DataFrame({"p": p.ravel(), "q": q.ravel() + first, "re": z.real.ravel(), "im": z.imag.ravel()})

    def rows(key, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0]) * tall
        z = transform(filled(pdf, first, (min(tall, n1 - first), n2), True), 1)
        p, q = np.indices(z.shape)
        return pd.DataFrame({"k": (p + first + n1 * q).ravel(), "re": z.real.ravel(), "im": z.imag.ravel()})

    cells = x.select(F.expr(f"k div {n2}").alias("p"), F.expr(f"k % {n2}").alias("q"), "re", "im")
    turned = cells.groupBy(F.expr(f"q div {wide}").alias("part")).applyInPandas(columns, _CELLS)
    return turned.groupBy(F.expr(f"p div {tall}").alias("part")).applyInPandas(rows, "k long, re double, im double")


def _times(a: DataFrame, b: DataFrame) -> DataFrame:
    """Products of two spectra (k, re, im)."""
    other = b.select("k", F.col("re").alias("c"), F.col("im").alias("d"))
    return a.join(other, "k").select("k", (F.col("re") * F.col("c") - F.col("im") * F.col("d")).alias("re"), (F.col("re") * F.col("d") + F.col("im") * F.col("c")).alias("im"))


def long_chirp(x: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """The transform of any length n as a convolution with a chirp, in transforms of a power of two."""
    size = 1 << (2 * n - 1).bit_length()
    sign = F.lit(1.0 if inverse else -1.0)
    angle = sign * np.pi * F.expr(f"double((CAST(k AS DECIMAL(19, 0)) * CAST(k AS DECIMAL(19, 0))) % {2 * n})") / n
    turn = lambda d: d.select("k", (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)).alias("re"), (F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)).alias("im"))
    k = x.sparkSession.range(n).select(F.col("id").alias("k"))
    chirp = k.select("k", F.cos(angle).alias("re"), (-F.sin(angle)).alias("im"))
    both = chirp.unionByName(chirp.where("k > 0").withColumn("k", size - F.col("k")))
    product = _times(long_fft(turn(x), size), long_fft(both, size))
    out = turn(long_fft(product, size, True).where(F.col("k") < n))
    return out.select("k", (F.col("re") / n).alias("re"), (F.col("im") / n).alias("im")) if inverse else out


def linear_convolution(x: DataFrame, nx: int, y: DataFrame, ny: int) -> DataFrame:
    """(i, v): the nx + ny - 1 entries of the convolution of two real vectors (i, v). Both go through one transform, as
    the real and imaginary part of one signal z; the product of their spectra is (z_k^2 - conj(z_-k)^2) / 4i."""
    n = nx + ny - 1
    size = 1 << max(0, n - 1).bit_length()
    z = x.select(F.col("i").alias("k"), F.col("v").alias("re"), F.lit(0.0).alias("im")).unionByName(y.select(F.col("i").alias("k"), F.lit(0.0).alias("re"), F.col("v").alias("im")))
    z = checkpoint(long_fft(z.groupBy("k").agg(F.sum("re").alias("re"), F.sum("im").alias("im")), size))
    squares = z.select("k", (F.col("re") ** 2 - F.col("im") ** 2).alias("re"), (2 * F.col("re") * F.col("im")).alias("im"))
    mirror = squares.select(F.pmod(F.lit(size) - F.col("k"), F.lit(size)).alias("k"), F.col("re").alias("c"), F.col("im").alias("d"))
    # (s - conj t) / 4i for s = re + i im and t = c + i d
    product = squares.join(mirror, "k").select("k", ((F.col("im") + F.col("d")) / 4).alias("re"), ((F.col("c") - F.col("re")) / 4).alias("im"))
    return long_fft(product, size, True).where(F.col("k") < n).select(F.col("k").alias("i"), F.col("re").alias("v"))


def bit_reversal(x: DataFrame, bits: int) -> DataFrame:
    """Entries moved to the index with reversed bits."""
    k = F.conv(F.reverse(F.lpad(F.bin("k"), bits, "0")), 2, 10).cast("bigint")
    return x.withColumn("k", k)
