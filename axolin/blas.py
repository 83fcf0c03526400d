"""The operators under their BLAS names."""

from __future__ import annotations

from axolin.operators.direct import trsm, trsv
from axolin.operators.product import gemm, gemv_axpby, ger
from axolin.operators.vector import axpby, dot, index_norm_inf, plane_rotation, reduce, scale

iamax, rot, scal = index_norm_inf, plane_rotation, scale


def asum(x):
    return reduce(x, "norm_1")


def nrm2(x):
    return reduce(x, "norm_2")


def axpy(alpha: float, x, y):
    """alpha x + y."""
    return axpby(alpha, x, 1.0, y)


def copy(x):
    return x.select(*x.columns)


def swap(x, y):
    return y, x


gemv = gemv_axpby

__all__ = ["asum", "axpy", "copy", "dot", "gemm", "gemv", "ger", "iamax", "nrm2", "rot", "scal", "swap", "trsm", "trsv"]
