"""Supervised members on the rolling-origin design: boosted trees, linear control, residual models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions import metrics as M
from panelloom.functions.exprs import clip
from panelloom.operators import boosting, origin
from panelloom.operators import design as D
from panelloom.operators.aggregates import unit_levels
from panelloom.operators.index import select_horizon
from panelloom.session import checkpointed, discard, stored
from panelloom.spec import PanelSpec

@dataclass(frozen=True)
class TreeConfig:
    rounds: int = 60
    depth: int = 6
    step: float = 0.1
    leaves: int = 63
    subsample: float = 0.8
    features: float = 0.8
    min_rows: int = 20
    bins: int = 64
    seed: int = 42
    loss: str = "absolute"
    # One split per level instead of the best leaf first.
    symmetric: bool = False
    stride: int = 168
    horizon: int | None = None
    futr: tuple[str, ...] = ()
    statics: tuple[str, ...] = ()
    fc_lags: tuple[int, ...] = ()
    unit: bool = False
    by_level: bool = False
    half_life: float | None = None
    weight: Callable[[], Column] | None = None

    def h(self, spec: PanelSpec) -> int:
        return spec.full_horizon if self.horizon is None else self.horizon


def symmetric_config(config: TreeConfig) -> TreeConfig:
    """The second tree family: symmetric trees of depth 6 on the same design with their own seed and rate."""
    return replace(config, depth=6, step=0.05, seed=config.seed + 1, features=1.0, symmetric=True)


@dataclass(frozen=True)
class TreeMember:
    model: boosting.Forest
    features: list[str]
    config: TreeConfig
    cut: int
    levels: DataFrame | None = None
    report: dict = field(default_factory=dict)


def _weighted(rows: DataFrame, df: DataFrame, spec: PanelSpec, config: TreeConfig, cut: int) -> tuple[DataFrame, DataFrame | None]:
    weight = config.weight() if config.weight else F.lit(1.0)
    if config.half_life:
        weight = weight * D.recency_weight(cut, config.half_life)
    out = rows.withColumn("weight", weight)
    if not config.by_level:
        return out, None
    levels = unit_levels(df, spec, cut)
    return D.scale_by_level(out, levels, spec, "weight"), levels


def _fit_rows(rows: DataFrame, spec: PanelSpec, features: list[str], config: TreeConfig, rounds: int) -> boosting.Forest:
    """Trees on rows that are written first, so that what they are made from runs once, and removed when the trees are grown."""
    keys = [c for c in (spec.id, spec.time, "o", "k") if c in rows.columns]
    kept = stored(rows.select(*dict.fromkeys([*keys, *features, spec.target, "weight"])), "design")
    forest = boosting.fit(
        kept, features, spec.target, "weight", F.xxhash64(*keys), rounds=rounds, step=config.step, leaves=config.leaves, depth=config.depth, least=config.min_rows,
        bins=config.bins, loss=config.loss, share=config.subsample, feature_share=config.features, seed=config.seed, category=D.UNIT, symmetric=config.symmetric,
    )
    discard(kept)
    return forest


def _features(spec: PanelSpec, config: TreeConfig) -> list[str]:
    return D.feature_columns(spec, config.futr, config.statics, config.fc_lags, config.unit)


def _design(df: DataFrame, pairs: DataFrame, spec: PanelSpec, config: TreeConfig, target: bool) -> DataFrame:
    return D.build_design(
        df, pairs, spec, futr=config.futr, statics=config.statics, fc_lags=config.fc_lags, unit=config.unit,
        target=target, horizon=config.h(spec),
    )


def fit_gapped(df: DataFrame, spec: PanelSpec, cut: int, config: TreeConfig, rounds: int | None = None) -> TreeMember:
    """Boosted trees on every (series, origin, step) whose target lies before the cut."""
    rows = D.training_design(
        df, spec, cut, stride=config.stride, horizon=config.h(spec), futr=config.futr, statics=config.statics,
        fc_lags=config.fc_lags, unit=config.unit,
    ).filter(F.col(spec.target).isNotNull())
    rows, levels = _weighted(rows, df, spec, config, cut)
    features = _features(spec, config)
    model = _fit_rows(rows, spec, features, config, rounds or config.rounds)
    return TreeMember(model, features, config, cut, levels)


def _score(member: TreeMember, rows: DataFrame) -> DataFrame:
    return boosting.forecast(member.model, rows, "_p")


def forecast_gapped(df: DataFrame, spec: PanelSpec, member: TreeMember, name: str = "tree", horizon: int | None = None) -> DataFrame:
    """All steps of the horizon from one origin per series; no forecast is fed back.

    ``horizon`` may go past the one the member was fitted for: every feature is still known, and the step itself
    counts as the largest the trees have seen. Forecast-anchored lags must reach back over it.
    """
    config = member.config if horizon is None else replace(member.config, horizon=horizon)
    pairs = D.inference_pairs(df, spec, member.cut, config.h(spec))
    rows = _score(member, _design(df, pairs, spec, config, target=False))
    if member.levels is not None:
        rows = rows.join(member.levels, spec.id).withColumn("_p", F.col("_p") * F.col("level")).drop("level")
    return rows.withColumn(name, clip(F.col("_p"), low=0.0)).select(
        spec.id, spec.time, F.lit(member.cut).cast("long").alias("cutoff"), F.col("k").alias("step"), name
    )


def tune_rounds(df: DataFrame, spec: PanelSpec, cut: int, config: TreeConfig, max_rounds: int = 100, patience: int = 10) -> dict:
    """Round count with the lowest validation error on a fold inside the train region.

    One fit; one pass over the fold then has the validation error after every round.
    """
    h = config.h(spec)
    score_len = spec.score_len
    train, valid = D.early_stopping_pairs(df, spec, cut, h, score_len, config.stride)
    seen = df.filter(F.col(spec.index) < cut)

    def rows(pairs: DataFrame) -> DataFrame:
        out = _design(seen, pairs, spec, config, target=True).filter(F.col(spec.target).isNotNull())
        return _weighted(out, seen, spec, config, cut)[0]

    tr, va = checkpointed(rows(train)), checkpointed(rows(valid))
    n_valid = va.count()
    if not n_valid:
        raise ValueError(f"the validation fold before cut {cut} is empty")
    features = _features(spec, config)
    model = _fit_rows(tr, spec, features, config, max_rounds)
    losses = boosting.staged_loss(boosting.pack(va, model.bins, spec.target, "weight", F.lit(0).cast("long")), model, config.loss)
    if not losses:
        raise ValueError(f"no split helps before cut {cut}")
    best = min(range(len(losses)), key=lambda i: (losses[i], i)) + 1
    return {
        "best_iteration": best, "best_score": float(losses[best - 1]), "max_rounds": max_rounds,
        "n_train_rows": tr.count(), "n_valid_rows": n_valid, "valid_from": cut - score_len, "valid_to": cut,
        "hit_ceiling": best >= max_rounds - patience,
    }


def predict_gapped(df: DataFrame, spec: PanelSpec, cut: int, config: TreeConfig, *, regime: str = "far", tune: int = 0, name: str = "tree") -> DataFrame:
    """Fit, forecast the horizon, keep the regime's half and join the labels; every row must have one."""
    rounds = tune_rounds(df, spec, cut, config, tune)["best_iteration"] if tune else None
    member = fit_gapped(df, spec, cut, config, rounds)
    block = select_horizon(forecast_gapped(df, spec, member, name), spec, regime)
    labels = df.select(spec.id, spec.time, spec.target)
    return block.join(labels, [spec.id, spec.time], "left")


# ---------------------------------------------------------------- linear control


def ridge_control(df: DataFrame, spec: PanelSpec, cut: int, horizon: int, columns: Sequence[str], reg: float = 1.0, name: str = "ridge") -> DataFrame:
    """Ridge on the known-future columns alone, fitted before the cut, scored over the horizon."""
    cols = list(columns)
    rows = df.withColumns({c: F.col(c).cast("double") for c in cols}).dropna(subset=cols)
    rows = VectorAssembler(inputCols=cols, outputCol="features").transform(rows)
    i = F.col(spec.index)
    fit = LinearRegression(labelCol=spec.target, elasticNetParam=0.0, regParam=reg).fit(
        rows.filter((i < cut) & F.col(spec.target).isNotNull())
    )
    out = fit.setPredictionCol("_p").transform(rows.filter((i >= cut) & (i < cut + horizon)))
    return out.select(
        spec.id, spec.time, F.lit(cut).cast("long").alias("cutoff"), (i - cut + 1).alias("step"), spec.target,
        clip(F.col("_p"), low=0.0).alias(name),
    )


# ---------------------------------------------------------------- residual models


def residual_member(df: DataFrame, spec: PanelSpec, cut: int, oof: DataFrame, preds: DataFrame, member: str, config: TreeConfig, name: str = "corrected") -> DataFrame:
    """Trees on (y - out-of-fold forecast); the correction is added to the member and clipped at zero."""
    samples = D.residual_samples(oof, df, spec, member)
    rows = _design(df, samples.select(spec.id, "o", "k"), spec, config, target=False)
    rows = rows.join(samples, [spec.id, "o", "k"]).withColumn(spec.target, F.col("residual")).withColumn("weight", F.lit(1.0))
    features = _features(spec, config)
    model = _fit_rows(rows.filter(F.col("residual").isNotNull()), spec, features, config, config.rounds)
    fitted = TreeMember(model, features, config, cut)
    pairs = D.inference_pairs(df, spec, cut, config.h(spec), first_step=config.h(spec) - spec.score_len + 1)
    corr = _score(fitted, _design(df, pairs, spec, config, target=False)).select(spec.id, spec.time, F.col("_p").alias("_c"))
    return preds.join(corr, [spec.id, spec.time]).withColumn(name, clip(F.col(member) + F.col("_c"), low=0.0)).drop("_c")


def to_residual_target(df: DataFrame, spec: PanelSpec, channel: str) -> DataFrame:
    """Train on what the channel leaves over."""
    return df.withColumn(spec.target, F.col(spec.target) - F.col(channel))


def from_residual_target(preds: DataFrame, frame: DataFrame, spec: PanelSpec, channel: str, pred: str) -> DataFrame:
    """Add the channel back by key; a forecast row without a channel value is refused."""
    back = frame.select(spec.id, spec.time, F.col(channel).alias("_c"))
    out = preds.join(back, [spec.id, spec.time], "left")
    holes = out.filter(F.col("_c").isNull()).count()
    if holes:
        raise ValueError(f"{holes} forecast rows have no {channel} to add back")
    return out.withColumn(pred, F.col(pred) + F.col("_c")).drop("_c")


# Shrink factors tried for a residual correction.
STACK_GRID = (0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0)


def residual_stacker(
    cube: DataFrame, spec: PanelSpec, blend: Column, members: Sequence[str], features: Sequence[str], fit_rows: Column,
    score_rows: Column, config: TreeConfig, gammas: Sequence[float] = STACK_GRID,
) -> DataFrame:
    """Trees on (y - blend) over covariates, member spread and position; the correction is shrunk.

    The shrink factor is picked on an inner split: the last third of the fitted windows' positions.
    """
    cols = [F.col(m) for m in members]
    rows = cube.withColumns(
        {"_blend": blend, "spread": F.greatest(*cols) - F.least(*cols)}
    ).withColumn("_r", F.col(spec.target) - F.col("_blend"))
    used = [*features, "spread"]
    fit = rows.filter(fit_rows)
    edge = fit.agg(F.percentile("blk", F.lit(2 / 3))).first()[0]
    inner = config

    def train(part: DataFrame) -> TreeMember:
        data = part.withColumn(spec.target, F.col("_r")).withColumn("weight", F.lit(1.0))
        model = _fit_rows(data, spec, used, inner, inner.rounds)
        return TreeMember(model, used, inner, 0)

    early = train(fit.filter(F.col("blk") < edge))
    held = checkpointed(_score(early, fit.filter(F.col("blk") >= edge)))
    y = F.col(spec.target)
    sums = held.agg(*(F.sum(F.abs(y - F.col("_blend") - F.lit(g) * F.col("_p"))).alias(f"g{i}") for i, g in enumerate(gammas))).first()
    gamma = min(zip(sums, gammas))[1]
    out = _score(train(fit), rows.filter(score_rows))
    stacked = clip(F.col("_blend") + F.lit(gamma) * F.col("_p"), low=0.0)
    return out.withColumn("stacked", stacked).agg(
        F.lit(gamma).alias("gamma"), M.wape(y, F.col("_blend")).alias("blend_wape"), M.wape(y, F.col("stacked")).alias("stacked_wape"),
        F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("delta", F.col("blend_wape") - F.col("stacked_wape"))


# ---------------------------------------------------------------- recursive forecasts


def _rolled(model: boosting.Forest, lags: Sequence[int], roll: int, need: int):
    """A function of a series' last values and its known columns ahead: the one-step forecasts, each fed to the next.

    All series of an Arrow batch advance together, a matrix with a row for each. Horizons may differ; a series with
    fewer than ``need`` values before the cut lacks its oldest.
    """

    @F.pandas_udf("array<double>")
    def run(hist, ahead):
        import numpy as np
        import pandas as pd

        sizes = np.array([len(a[0]) if len(a) else 0 for a in ahead], np.int64)
        values = np.full((len(hist), need + int(sizes.max(initial=0))), np.nan)
        for row, h in zip(values, hist):
            h = np.array(h, np.float64)[-need:]
            row[need - len(h) : need] = h
        known = [np.full((len(hist), int(sizes.max(initial=0))), np.nan) for _ in range(len(ahead.iloc[0]) if len(ahead) else 0)]
        for i, a in enumerate(ahead):
            for column, own in zip(known, a):
                column[i, : sizes[i]] = np.array(own, np.float64)
        for step in range(values.shape[1] - need):
            at = need + step
            live = np.flatnonzero(sizes > step)
            window = values[live, at - roll : at]
            features = [*(values[live, at - n] for n in lags), window.sum(axis=1) / roll, *(c[live, step] for c in known)]
            values[live, at] = model.predict(features)
        return pd.Series([v[need : need + n] for v, n in zip(values, sizes)])

    return run


def recursive_trees(df: DataFrame, spec: PanelSpec, cut: int, horizon: int, config: TreeConfig, lags: Sequence[int] = (1, 2, 7, 14, 28), roll: int = 7, name: str = "recursive") -> DataFrame:
    """One-step trees of squared loss rolled forward in one plan whatever the horizon.

    A series is one row with the last values any lag needs and its known columns ahead; the steps run inside a task.
    """
    from panelloom.functions import ordered

    y, i = F.col(spec.target), F.col(spec.index)
    need = max(*lags, roll)
    futr = list(config.futr)
    calendar = {"dow": F.weekday(spec.time).cast("double"), "hour": F.hour(spec.time).cast("double")}
    names = [*(f"lag_{n}" for n in lags), f"roll_{roll}", *calendar, *futr]
    train = ordered.over_index(
        df.filter(i < cut).withColumns(calendar), spec,
        lambda w: {
            **{f"lag_{n}": F.lag(y, n).over(w) for n in lags},
            f"roll_{roll}": F.avg(y).over(w.rowsBetween(-roll, -1)),
        },
        back=need,
    ).filter(i >= need).withColumn("weight", F.lit(1.0))
    config = replace(config, loss="squared")
    model = _fit_rows(train.dropna(subset=names), spec, names, config, config.rounds)
    tail = df.filter((i >= cut - need) & (i < cut)).groupBy(spec.id).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(i, y.alias("v")))), lambda s: s["v"]).alias("_hist")
    )
    known = [*calendar, *futr]
    ahead = df.filter((i >= cut) & (i < cut + horizon)).withColumns(calendar)
    packed = F.array_sort(F.collect_list(F.struct(i.alias("i"), F.col(spec.time).alias("t"), *(F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(known)))))
    state = tail.join(ahead.groupBy(spec.id).agg(packed.alias("_fut")), spec.id)
    columns = [F.expr(f"transform(_fut, s -> s._x{j})") for j in range(len(known))]
    out = state.withColumn("_out", _rolled(model, lags, roll, need)("_hist", F.array(*columns)))
    pairs = F.arrays_zip(F.transform("_fut", lambda s: s["t"]).alias("t"), F.col("_out").alias("p"))
    out = out.select(spec.id, F.posexplode(pairs).alias("_k", "_r"))
    return out.select(
        spec.id, F.col("_r.t").alias(spec.time), F.lit(cut).cast("long").alias("cutoff"),
        (F.col("_k") + 1).cast("long").alias("step"), clip(F.col("_r.p"), low=0.0).alias(name),
    )


def rollout(df: DataFrame, spec: PanelSpec, cut: int, horizon: int, block: int, method: str = "seasonal_naive", name: str = "rollout") -> DataFrame:
    """Past the trained horizon: each block's forecast becomes history for the next one."""
    keep = [spec.id, spec.time, spec.index]
    history = df.filter(F.col(spec.index) < cut).select(*keep, spec.target)
    future = df.select(*keep)
    out, start = None, cut
    while start < cut + horizon:
        length = min(block, cut + horizon - start)
        rows, _ = origin.forecast_horizon(
            history.unionByName(future.filter(F.col(spec.index) >= start).withColumn(spec.target, F.lit(None).cast("double"))),
            spec, start, length, method, name,
        )
        part = checkpointed(rows.select(*keep, name))
        out = part if out is None else out.unionByName(part)
        history = history.unionByName(part.select(*keep, F.col(name).alias(spec.target)))
        start += length
    return out.withColumn("cutoff", F.lit(cut).cast("long")).withColumn("step", (F.col(spec.index) - cut + 1).cast("long"))


def predict_arms(df: DataFrame, spec: PanelSpec, member: TreeMember, arms: dict[str, DataFrame], name: str = "tree") -> DataFrame:
    """One fitted member over several future frames: the arms are rows of one scored frame."""
    cut, h = member.cut, member.config.h(spec)
    futr = list(member.config.futr)
    pairs = D.inference_pairs(df, spec, cut, h)
    plain = _design(df, pairs, spec, member.config, target=False).drop(*futr)
    frames = None
    for arm, future in arms.items():
        part = future.select(spec.id, spec.time, *futr).withColumn("arm", F.lit(arm))
        frames = part if frames is None else frames.unionByName(part)
    rows = _score(member, plain.join(frames, [spec.id, spec.time]))
    if member.levels is not None:
        rows = rows.join(member.levels, spec.id).withColumn("_p", F.col("_p") * F.col("level")).drop("level")
    return rows.withColumn(name, clip(F.col("_p"), low=0.0)).select(
        "arm", spec.id, spec.time, F.lit(cut).cast("long").alias("cutoff"), F.col("k").alias("step"), name
    )
