"""Exact statistics of one column as aggregate expressions.

All skip nulls. Each is null on an empty column unless stated. Expressions of
many columns go into one ``agg``. ``mode`` and ``percentile`` hold a column's distinct
values in one task and are for small groups; tables go by :mod:`quarry.functions.values`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(c: Column) -> Column:
    return F.avg(c)


def variance(c: Column, ddof: int = 0) -> Column:
    """Null where there are not more than ``ddof`` values."""
    return F.var_samp(c) if ddof == 1 else F.var_pop(c)


def std(c: Column, ddof: int = 0) -> Column:
    return F.stddev_samp(c) if ddof == 1 else F.stddev_pop(c)


def mode(c: Column) -> Column:
    """Most frequent value; the smallest of those that tie."""
    return F.mode(c, True)


def percentile(c: Column, q: float) -> Column:
    """Exact, with linear interpolation; q from 0 to 100."""
    if not 0 <= q <= 100:
        raise ValueError("a percentile is from 0 to 100")
    return F.percentile(c, F.lit(q / 100.0))


def skewness(c: Column) -> Column:
    """Adjusted Fisher-Pearson; null under 3 values, 0 for a constant."""
    n = F.count(c).cast("double")
    adjusted = F.coalesce(F.skewness(c), F.lit(0.0)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(F.count(c) >= 3, F.when(F.min(c) == F.max(c), 0.0).otherwise(adjusted))


def kurtosis(c: Column) -> Column:
    """Sample excess; null under 4 values, 0 for a constant."""
    n = F.count(c).cast("double")
    adjusted = ((n + 1) * F.coalesce(F.kurtosis(c), F.lit(0.0)) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(F.count(c) >= 4, F.when(F.min(c) == F.max(c), 0.0).otherwise(adjusted))


def pearson(x: Column, y: Column) -> Column:
    """Over rows where both are present; 0 for a constant side or fewer than two rows."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.coalesce(F.try_divide(F.covar_pop(a, b), spread), F.lit(0.0))


#: Names of the fifteen statistics of a numeric column, in order.
PROFILE = ("count", "missing", "mean", "median", "mode", "std", "variance", "min", "max", "range", "q1", "q3", "iqr", "skewness", "kurtosis")
#: Name -> expression of those that need no order or counts of values.
MOMENTS = {
    "count": F.count,
    "missing": lambda c: F.count_if(c.isNull()),
    "mean": mean,
    "std": lambda c: std(c, 1),
    "variance": lambda c: variance(c, 1),
    "min": F.min,
    "max": F.max,
    "skewness": skewness,
    "kurtosis": kurtosis,
}
