"""Calendar encodings and the linear trend: checked on supplied rows, then used on absent ones."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.exprs import hours_between, wave

# Agreement asked of supplied rows before a formula is used on absent ones.
PERIODIC_TOL = 1e-9
TREND_TOL = 1e-6


def periodic_encodings(ts: Column) -> dict[str, Column]:
    hour, dow = F.hour(ts).cast("double"), F.weekday(ts).cast("double")
    return {
        "hour_sin": wave(F.sin, hour, 24.0),
        "hour_cos": wave(F.cos, hour, 24.0),
        "dow_sin": wave(F.sin, dow, 7.0),
        "dow_cos": wave(F.cos, dow, 7.0),
        "is_weekend": (dow >= 5).cast("double"),
    }


def periodic_gap(df: DataFrame, time: str) -> DataFrame:
    """One row: the largest disagreement between each supplied encoding and its closed form."""
    want = {n: x for n, x in periodic_encodings(F.col(time)).items() if n in df.columns}
    return df.filter(F.col(time).isNotNull()).agg(
        F.count(F.lit(1)).alias("n_rows"), *(F.max(F.abs(F.col(n) - x)).alias(n) for n, x in want.items())
    )


def verify_periodic(supplied: DataFrame, time: str, tol: float = PERIODIC_TOL) -> None:
    row = periodic_gap(supplied, time).first().asDict()
    if not row.pop("n_rows"):
        raise ValueError("no supplied rows to verify the calendar encodings against")
    bad = {n: d for n, d in row.items() if d is not None and d > tol}
    if bad:
        raise ValueError(f"calendar encodings differ from the closed form on supplied rows: {bad}")


def complete_periodic(df: DataFrame, time: str, supplied: DataFrame | None = None) -> DataFrame:
    """Fill absent encodings from the timestamp; a supplied value is kept."""
    verify_periodic(df if supplied is None else supplied, time)
    want = periodic_encodings(F.col(time))
    return df.withColumns({n: F.coalesce(F.col(n), x) if n in df.columns else x for n, x in want.items()})


@dataclass(frozen=True)
class TrendLine:
    slope: float
    intercept: float
    origin: datetime

    def at(self, ts: Column) -> Column:
        return F.lit(self.slope) * hours_between(ts, F.lit(self.origin)) + F.lit(self.intercept)


def fit_trend(df: DataFrame, time: str, trend: str = "trend", tol: float = TREND_TOL) -> TrendLine:
    """Least-squares line of ``trend`` over hours since the first observed row; refuses a curve."""
    seen = df.filter(F.col(trend).isNotNull() & F.col(time).isNotNull())
    ends = seen.agg(F.count(F.lit(1)), F.min(time), F.max(time)).first()
    if ends[0] < 2:
        raise ValueError(f"need at least 2 observed trend rows, got {ends[0]}")
    if ends[1] == ends[2]:
        raise ValueError("all observed trend rows share one timestamp")
    hours = hours_between(F.col(time), F.lit(ends[1]))
    line = seen.agg(
        F.regr_slope(F.col(trend), hours).alias("a"), F.regr_intercept(F.col(trend), hours).alias("b")
    ).first()
    fit = TrendLine(line["a"], line["b"], ends[1])
    worst = seen.agg(F.max(F.abs(F.col(trend) - fit.at(F.col(time))))).first()[0]
    if worst > tol:
        raise ValueError(f"trend is not linear in time: max residual {worst:.3e} > {tol:.0e}")
    return fit


def complete_trend(df: DataFrame, time: str, supplied: DataFrame | None = None, trend: str = "trend") -> DataFrame:
    """Extrapolate the line the observed rows imply; supplied values are kept."""
    source = supplied if supplied is not None and trend in supplied.columns else df
    line = fit_trend(source, time, trend)
    value = line.at(F.col(time))
    return df.withColumn(trend, F.coalesce(F.col(trend), value) if trend in df.columns else value)
