"""Rolling-origin design: (series, origin, step) rows with features known at the origin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions import ordered
from panelloom.spec import PanelSpec

UNIT = "unit_id"
STEP = "horizon_step"


def check_forecast_lags(lags: Sequence[int], horizon: int) -> list[int]:
    """A lag counted back from the forecast row must reach the origin at every step."""
    lags = [int(n) for n in lags]
    short = [n for n in lags if n < horizon]
    if short:
        raise ValueError(f"forecast-anchored lags {short} are shorter than the horizon {horizon} and would read the future")
    if len(set(lags)) != len(lags):
        raise ValueError(f"duplicate forecast-anchored lags: {lags}")
    return lags


def feature_columns(spec: PanelSpec, futr: Sequence[str], statics: Sequence[str], fc_lags: Sequence[int] = (), unit: bool = False) -> list[str]:
    """Fixed order: lags, forecast-anchored lags, rolling means, step, covariates, statics, unit."""
    return [
        *(f"lag_{n}" for n in spec.lags),
        *(f"wlag_{n}" for n in fc_lags),
        *(f"roll_{n}" for n in spec.rolls),
        STEP,
        *futr,
        *statics,
        *([UNIT] if unit else []),
    ]


def _steps(first: int, last: Column) -> Column:
    return F.explode(F.when(last >= first, F.sequence(F.lit(first).cast("long"), last.cast("long"))))


def training_pairs(df: DataFrame, spec: PanelSpec, cut: int, horizon: int | None = None, stride: int = 168) -> DataFrame:
    """Origins back from ``cut-1`` by ``stride`` (above 0), steps while the target stays below the cut."""
    h = spec.full_horizon if horizon is None else horizon
    last = df.groupBy(spec.id).agg(F.least(F.max(spec.index), F.lit(cut - 1)).alias("_last"))
    origins = F.explode(F.when(F.col("_last") >= 1, F.sequence(F.col("_last"), F.lit(1).cast("long"), F.lit(-stride).cast("long"))))
    out = last.select(spec.id, origins.alias("o"))
    return out.withColumn("k", _steps(1, F.least(F.lit(h), F.lit(cut - 1) - F.col("o"))))


def inference_pairs(df: DataFrame, spec: PanelSpec, cut: int, horizon: int | None = None, first_step: int = 1) -> DataFrame:
    h = spec.full_horizon if horizon is None else horizon
    ids = df.select(spec.id).distinct()
    return ids.withColumn("o", F.lit(cut - 1).cast("long")).withColumn("k", _steps(first_step, F.lit(h)))


def early_stopping_pairs(df: DataFrame, spec: PanelSpec, cut: int, horizon: int | None = None, score_len: int | None = None, stride: int = 168) -> tuple[DataFrame, DataFrame]:
    """Train pairs with the cut pulled back by the scored length; validation across a full horizon."""
    h = spec.full_horizon if horizon is None else horizon
    n = spec.score_len if score_len is None else score_len
    return (
        training_pairs(df, spec, cut - n, h, stride),
        inference_pairs(df, spec, cut - h, h, first_step=h - n + 1),
    )


def origin_features(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Per panel row, what an origin there knows: ``lag_l = y[o-(l-1)]`` and trailing means."""
    y = F.col(spec.target)
    out = df.select(spec.id, spec.index, spec.target)
    out = ordered.lagged(out, spec, {f"lag_{n}": (y, n - 1) for n in spec.lags})
    out = ordered.rolling_mean(out, spec, {f"roll_{n}": (y, n) for n in spec.rolls}, centred=False)
    return out.withColumnRenamed(spec.index, "o").drop(spec.target)


def forecast_features(df: DataFrame, spec: PanelSpec, futr: Sequence[str], statics: Sequence[str], fc_lags: Sequence[int] = (), target: bool = True) -> DataFrame:
    """Per panel row, what is known about a forecast row there: covariates, statics, ``y[fc-l]``."""
    y = F.col(spec.target)
    keep = [spec.id, spec.time, spec.index, spec.target, *futr, *statics]
    out = df.select(*dict.fromkeys(keep))
    if fc_lags:
        out = ordered.lagged(out, spec, {f"wlag_{n}": (y, n) for n in fc_lags})
    out = out.withColumnRenamed(spec.index, "_fc")
    return out if target else out.drop(spec.target)


def build_design(
    df: DataFrame,
    pairs: DataFrame,
    spec: PanelSpec,
    *,
    futr: Sequence[str] = (),
    statics: Sequence[str] = (),
    fc_lags: Sequence[int] = (),
    unit: bool = False,
    target: bool = True,
    horizon: int | None = None,
) -> DataFrame:
    """Features for explicit (series, origin, step) rows.

    Origin features are computed once on the panel and joined on (series, origin); forecast-side
    features are joined on (series, origin + step), so wide rows are never exploded.
    """
    fc_lags = check_forecast_lags(fc_lags, spec.full_horizon if horizon is None else horizon)
    out = pairs.join(origin_features(df, spec), [spec.id, "o"], "left").withColumn("_fc", F.col("o") + F.col("k"))
    return _with_forecast_side(out, df, spec, futr, statics, fc_lags, unit, target)


def training_design(
    df: DataFrame,
    spec: PanelSpec,
    cut: int,
    *,
    stride: int = 168,
    horizon: int | None = None,
    futr: Sequence[str] = (),
    statics: Sequence[str] = (),
    fc_lags: Sequence[int] = (),
    unit: bool = False,
) -> DataFrame:
    """``build_design`` over ``training_pairs`` with the steps unrolled from the origin rows themselves."""
    h = spec.full_horizon if horizon is None else horizon
    fc_lags = check_forecast_lags(fc_lags, h)
    known = df.filter(F.col(spec.index) < cut)
    ends = known.groupBy(spec.id).agg(F.max(spec.index).alias("_last"))
    o = F.col("o")
    origins = origin_features(known, spec).join(ends, spec.id).filter(
        (o > 0) & (F.pmod(F.col("_last") - o, F.lit(stride)) == 0)
    )
    pairs = origins.drop("_last").withColumn("k", _steps(1, F.least(F.lit(h), F.lit(cut - 1) - o)))
    return _with_forecast_side(pairs.withColumn("_fc", o + F.col("k")), df, spec, futr, statics, fc_lags, unit, True)


def _with_forecast_side(out, df, spec, futr, statics, fc_lags, unit, target):
    side = forecast_features(df, spec, futr, [], fc_lags, target)
    out = out.join(side, [spec.id, "_fc"], "left").drop("_fc").withColumn(STEP, F.col("k"))
    if statics:
        fixed = df.groupBy(spec.id).agg(*(F.min_by(c, spec.index).alias(c) for c in statics))
        out = out.join(fixed, spec.id, "left")
    if unit:
        out = out.join(ordered.sorted_codes(df, spec.id, UNIT), spec.id, "left")
    cols = feature_columns(spec, futr, statics, fc_lags, unit)
    return out.select(spec.id, spec.time, "o", "k", *cols, *([spec.target] if target else []))


def recency_weight(cut: int, half_life: float, origin: str = "o") -> Column:
    """Halves with the age of the origin; a row without an origin keeps weight 1."""
    age = F.lit(float(cut - 1)) - F.col(origin)
    return F.coalesce(F.pow(F.lit(0.5), age / F.lit(float(half_life))), F.lit(1.0))


def scale_by_level(design: DataFrame, levels: DataFrame, spec: PanelSpec, weight: str | None = None) -> DataFrame:
    """(y / level, weight * level) applied together, so that absolute error keeps its own units."""
    base = F.col(weight) if weight else F.lit(1.0)
    return (
        design.join(levels, spec.id)
        .withColumn("weight", base * F.col("level"))
        .withColumn(spec.target, F.col(spec.target) / F.col("level"))
    )


def residual_samples(oof: DataFrame, df: DataFrame, spec: PanelSpec, member: str) -> DataFrame:
    """Out-of-fold rows with cutoff timestamps to (id, o, k, residual), k counted from the origin row."""
    at = df.select(spec.id, spec.time, spec.index)
    rows = oof.join(at.withColumnRenamed(spec.index, "_fc"), [spec.id, spec.time])
    start = at.select(spec.id, F.col(spec.time).alias("cutoff"), F.col(spec.index).alias("o"))
    return (
        rows.join(start, [spec.id, "cutoff"])
        .withColumn("k", F.col("_fc") - F.col("o"))
        .withColumn("residual", F.col(spec.target) - F.col(member))
        .filter(F.col("k") >= 1)
        .select(spec.id, "o", "k", "residual")
    )
