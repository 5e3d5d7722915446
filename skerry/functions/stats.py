"""Normal-distribution functions and proper scores as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    a1, a2, a3, a4, a5 = ERF_A
    tail = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-x * x)
    return F.signum(x) * (1.0 - tail)


def normal_pdf(z: Column) -> Column:
    return F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1.0 + erf(z / math.sqrt(2.0)))


def crps(y: Column, mu: Column, sigma: Column) -> Column:
    """Closed form for a Gaussian forecast."""
    z = (y - mu) / sigma
    return sigma * (z * (2.0 * normal_cdf(z) - 1.0) + 2.0 * normal_pdf(z) - 1.0 / math.sqrt(math.pi))


def nlpd(y: Column, mu: Column, sigma: Column) -> Column:
    return 0.5 * F.log(2 * math.pi * sigma * sigma) + 0.5 * F.pow((y - mu) / sigma, 2)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
