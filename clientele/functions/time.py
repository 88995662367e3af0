"""Day arithmetic on TIMESTAMP_NTZ, independent of the session time zone."""

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_timestamp(as_of: "str | dt.datetime | Column") -> Column:
    """The as-of argument as a TIMESTAMP_NTZ column."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, dt.datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.lit(as_of).cast("timestamp_ntz")


def days_before(as_of, days: int) -> Column:
    return as_timestamp(as_of) - F.make_dt_interval(days=F.lit(days))


def hours_before(as_of, hours: int) -> Column:
    return as_timestamp(as_of) - F.make_dt_interval(hours=F.lit(hours))


def whole_days(start: Column, as_of, toward_zero: bool = False) -> Column:
    """Complete 24 h periods from ``start`` to ``as_of``.

    A ``start`` in the future counts down (floor), or to zero with ``toward_zero``.
    """
    end = as_timestamp(as_of)
    elapsed = F.extract(F.lit("DAY"), end - start)
    if toward_zero:
        return elapsed.cast("int")
    almost_a_day = F.make_dt_interval(
        hours=F.lit(23), mins=F.lit(59), secs=F.lit("59.999999").cast("decimal(8,6)")
    )
    overdue = -F.extract(F.lit("DAY"), (start - end) + almost_a_day)
    return F.when(start <= end, elapsed).when(start > end, overdue).cast("int")
