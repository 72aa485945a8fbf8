"""Small column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_nan(x: Column) -> Column:
    """NaN is 'unavailable' in a source file; inside the engine that is NULL."""
    return F.when(~F.isnan(x), x)


def hour_of_week(ts: Column) -> Column:
    """Calendar bin 0..167, Monday 00h first."""
    return F.weekday(ts) * 24 + F.hour(ts)


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a column; NULL stays NULL (``greatest`` alone would skip it)."""
    out = x
    if low is not None:
        out = F.when(out < F.lit(low), F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > F.lit(high), F.lit(high)).otherwise(out)
    return out


def ratio(num: Column, den: Column) -> Column:
    """num/den with a zero denominator giving NULL."""
    return num / F.nullif(den, F.lit(0.0))


def wave(fn, x: Column, period: float) -> Column:
    return fn(F.lit(2 * math.pi) * x / F.lit(period))
