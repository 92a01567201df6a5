"""Scalar and small-vector expressions, all inside codegen or higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerances of the three number kinds (integers compare exactly).
EPSILON = {"int": None, "float": 1e-6, "double": 1e-11}


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.least(high, F.greatest(low, v))


def epsilon_eq(a: Column, b: Column, kind: str = "double") -> Column:
    eps = EPSILON[kind]
    return a == b if eps is None else F.abs(a.cast("double") - b.cast("double")) < eps


def quantize(v: Column) -> Column:
    """Nearest whole number, halves away from zero."""
    return F.round(v).cast("bigint")


def int_pow(base: Column, n: int) -> Column:
    if n < 1:
        raise ValueError("n must be at least 1")
    out = base.cast("bigint")
    for _ in range(n - 1):
        out = out * base.cast("bigint")
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dist_sqrd(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def negate(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def orthogonal(x: Column, y: Column) -> Column:
    """A quarter turn, (-y, x); the axis convention is inferred."""
    return F.array(-y, x)


def homogeneous(x: Column, y: Column) -> Column:
    return F.array(x.cast("double"), y.cast("double"), F.lit(1.0))


def orientation(x1, y1, x2, y2, x3, y3) -> Column:
    """-1, 0 or 1: the third point lies left of, on or right of the line through the first two."""
    return (-F.signum((x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1))).cast("int")
