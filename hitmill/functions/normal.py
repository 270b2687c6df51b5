"""The normal distribution as column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# A published rational Chebyshev fit of erfc, right to 1.2e-7 of its value.
ERFC = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def erfc(x: Column) -> Column:
    """The complementary error function of ``x`` >= 0."""
    t = 1 / (1 + x / 2)
    series = F.lit(ERFC[-1])
    for factor in reversed(ERFC[:-1]):
        series = F.lit(factor) + t * series
    return t * F.exp(series - x * x)


def two_sided(z: Column) -> Column:
    """How likely a standard normal value is as far from zero as ``z``."""
    return F.least(erfc(F.abs(z) / F.sqrt(F.lit(2.0))), F.lit(1.0))


def quantile(share: float) -> float:
    """The value that a standard normal one stays below with this probability."""
    return NormalDist().inv_cdf(share)
