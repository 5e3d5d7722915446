"""Compact-support and stationary kernels as column expressions of distance; every support is closed at t = 1."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _inside(t: Column, value: Column) -> Column:
    return F.when(t < 1, value).otherwise(F.lit(0.0))


def scaled(d: Column, rho) -> Column:
    return F.least(d / rho, F.lit(1.0))


def wendland_c2(t: Column) -> Column:
    """(1-t)^4 (4t+1)."""
    return _inside(t, F.pow(1 - t, 4) * (4 * t + 1))


def wendland(t: Column, dim: int, k: int) -> Column:
    """The dimension-correct family: l = dim // 2 + k + 1, smoothness 2k."""
    l = dim // 2 + k + 1  # noqa: E741
    polynomial = {
        0: F.lit(1.0),
        1: (l + 1) * t + 1,
        2: ((l * l + 4 * l + 3) * t * t + (3 * l + 6) * t + 3) / 3,
        3: ((l**3 + 9 * l * l + 23 * l + 15) * t * t * t + (6 * l * l + 36 * l + 45) * t * t + (15 * l + 45) * t + 15) / 15,
    }[k]
    return _inside(t, F.pow(1 - t, l + k) * polynomial)


def octic_35(t: Column) -> Column:
    """(1-t)^8 (35t^3+25t^2+8t+1); not the textbook function, whose leading coefficient is 32."""
    return _inside(t, F.pow(1 - t, 8) * (35 * t * t * t + 25 * t * t + 8 * t + 1))


def octic_32(t: Column) -> Column:
    """(1-t)^8 (32t^3+25t^2+8t+1)."""
    return _inside(t, F.pow(1 - t, 8) * (32 * t * t * t + 25 * t * t + 8 * t + 1))


def matern52(d: Column, length: float) -> Column:
    s = math.sqrt(5.0) * d / length
    return (1 + s + s * s / 3) * F.exp(-s)


def exponential(d: Column, length: float) -> Column:
    return F.exp(-d / length)


def gaussian(d: Column, length: float) -> Column:
    return F.exp(-d * d / (2 * length * length))


def box_product(a: Column, b: Column, length: float) -> Column:
    """Product over dimensions of (1-t)^3 (3t+1): positive definite in any dimension, box support."""
    t = lambda x, y: F.least(F.abs(x.cast("double") - y.cast("double")) / length, F.lit(1.0))
    one = lambda t: F.pow(1 - t, 3) * (3 * t + 1)
    return F.aggregate(F.zip_with(a, b, lambda x, y: one(t(x, y))), F.lit(1.0), lambda p, v: p * v)


def additive(parts: list[tuple[float, Column, float]]) -> Column:
    """Sum of signal variance times C2 over channels; the support is the union of the channels' supports."""
    return reduce(lambda x, y: x + y, (sv * wendland_c2(scaled(d, rho)) for sv, d, rho in parts))


def product(sv: float, parts: list[tuple[Column, float]]) -> Column:
    """One signal variance times the product of C2 over channels; the support is the intersection."""
    return reduce(lambda x, y: x * y, (wendland_c2(scaled(d, rho)) for d, rho in parts), F.lit(float(sv)))


def gibbs(d: Column, la: Column, lb: Column, dim: int) -> Column:
    """Non-stationary: prefactor (2 l l' / (l^2+l'^2))^(dim/2) with the ambient dimension, C2 of d / sqrt(l^2+l'^2)."""
    s = la * la + lb * lb
    return F.pow(2 * la * lb / s, dim / 2) * wendland_c2(scaled(d, F.sqrt(s)))


def kernel_distance(kii: Column, kjj: Column, kij: Column) -> Column:
    return F.sqrt(F.greatest(kii + kjj - 2 * kij, F.lit(0.0)))
