"""Rounding, clamping and order-independent sums."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    """Round to ``digits`` decimals, ties to the even digit (Spark's ``round`` goes half up); never to a negative zero."""
    if digits == 0:
        return F.rint(x) + 0.0
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale + 0.0


def clamp(x: Column, low: float, high: float) -> Column:
    """Limit ``x`` to [low, high]; null stays null (``least``/``greatest`` alone would skip it)."""
    limited = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return F.when(x.isNotNull(), limited)


def stable_sum(x: Column, digits: int = 6) -> Column:
    """Sum of doubles without the noise that depends on the order of the partial sums."""
    return half_even(F.sum(x), digits)
