"""Aggregates that follow the usual sample conventions and survive constant columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; null when either side is constant.

    ``corr`` itself divides by zero there, which is an error in ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def skewness(value: Column, n: Column) -> Column:
    """Bias-corrected skewness; null below 3 rows."""
    return F.when(n >= 3, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)) * F.skewness(value))


def kurtosis(value: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis; null below 4 rows."""
    return F.when(n >= 4, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * F.kurtosis(value) + 6))
