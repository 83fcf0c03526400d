"""Column expressions for element-wise mathematics, with IEEE results where SQL would raise or give NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ieee_log(fn):
    """log(0) is -inf and log of a negative number NaN."""
    return lambda v: F.when(v > 0, fn(v)).when(v == 0, F.lit(float("-inf"))).when(v.isNotNull(), F.lit(float("nan")))


def ieee_div(x: Column, y: Column) -> Column:
    """x / y, where division by zero gives an infinity or NaN."""
    by_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, by_zero).otherwise(x / F.when(y != 0, y))


def _erf_near(v: Column) -> Column:
    """erf for |v| <= 2 as 2 / sqrt(pi) exp(-v^2) v (1 + 2 v^2 / 3 (1 + 2 v^2 / 5 (1 + ...))), whose terms have one sign."""
    total = F.lit(1.0)
    for n in range(36, 0, -1):
        total = 1 + 2 * v * v / (2 * n + 1) * total
    return 2 / math.pi**0.5 * F.exp(-v * v) * v * total


def _erfc_far(v: Column) -> Column:
    """erfc for v >= 2 by its continued fraction exp(-v^2) / sqrt(pi) / (v + (1/2) / (v + 1 / (v + (3/2) / (v + ...))))."""
    total = v
    for n in range(60, 0, -1):
        total = v + n / 2 / total
    return F.exp(-v * v) / (math.pi**0.5 * total)


def erf(v: Column) -> Column:
    far = F.greatest(F.abs(v), F.lit(2.0))
    return F.when(F.abs(v) <= 2, _erf_near(v)).otherwise(F.signum(v) * (1 - _erfc_far(far)))


def erfc(v: Column) -> Column:
    far = F.greatest(F.abs(v), F.lit(2.0))
    return F.when(F.abs(v) <= 2, 1 - _erf_near(v)).when(v > 0, _erfc_far(far)).otherwise(2 - _erfc_far(far))


#: Functions of one value.
UNARY = {
    "abs": F.abs, "acos": F.acos, "acosh": F.acosh, "asin": F.asin, "asinh": F.asinh, "atan": F.atan, "atanh": F.atanh,
    "ceil": lambda v: F.ceil(v).cast("double"), "cos": F.cos, "cosh": F.cosh, "erf": erf, "erfc": erfc, "exp": F.exp,
    "exp2": lambda v: F.pow(F.lit(2.0), v), "exp10": lambda v: F.pow(F.lit(10.0), v), "fabs": F.abs,
    "floor": lambda v: F.floor(v).cast("double"), "log": ieee_log(F.ln), "log2": ieee_log(F.log2), "log10": ieee_log(F.log10),
    "round": lambda v: F.round(v), "rsqrt": lambda v: F.pow(v, F.lit(-0.5)), "sign": F.signum, "sin": F.sin, "sinh": F.sinh,
    "sqrt": F.sqrt, "tan": F.tan, "tanh": F.tanh, "trunc": lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double"),
    "neg": lambda v: -v,
}
#: f(0) is not 0: sparse operands must be made dense first.
DENSE_ONLY = frozenset("acos acosh cos cosh erfc exp exp2 exp10 log log2 log10 rsqrt".split())

_flag = lambda c: c.cast("double")
#: Functions of two values; comparisons give 0 or 1.
BINARY = {
    "prod": lambda x, y: x * y, "div": ieee_div, "pow": F.pow, "add": lambda x, y: x + y, "sub": lambda x, y: x - y,
    "eq": lambda x, y: _flag(x == y), "neq": lambda x, y: _flag(x != y), "greater": lambda x, y: _flag(x > y),
    "less": lambda x, y: _flag(x < y), "geq": lambda x, y: _flag(x >= y), "leq": lambda x, y: _flag(x <= y),
    "atan2": F.atan2, "fdim": lambda x, y: F.greatest(x - y, F.lit(0.0)), "fmod": lambda x, y: x % F.when(y != 0, y),
    "fmax": F.greatest, "fmin": F.least,
}
#: Numeric types and what stands for them; types without a sign take the next wider one.
CASTS = {"char": "tinyint", "uchar": "smallint", "short": "smallint", "ushort": "int", "int": "int", "uint": "bigint", "long": "bigint", "ulong": "decimal(20,0)", "half": "float", "float": "float", "double": "double"}


def convert(v: Column, kind: str) -> Column:
    """Truncates towards zero for integral types; values out of range raise."""
    whole = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)) if CASTS[kind].startswith("decimal") else v
    return whole.cast(CASTS[kind])
