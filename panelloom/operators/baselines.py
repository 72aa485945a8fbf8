"""Seasonal baselines over any set of windows, as equi-joins into the history.

A window row carries its own ``cutoff`` (train end) and 1-based ``step``; since positions are
contiguous, 'the last value' and 'the value one season back' are exact positions to look up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import quantiles
from panelloom.functions.exprs import ratio
from panelloom.operators.index import horizons
from panelloom.spec import PanelSpec

_SRC = "_src"


def _lookup(windows: DataFrame, df: DataFrame, spec: PanelSpec, name: str, positions: Column | None) -> DataFrame:
    known = df if positions is None else df.filter(positions)
    source = known.select(spec.id, F.col(spec.index).alias(_SRC), F.col(spec.target).alias(name))
    return windows.join(source, [spec.id, _SRC], "left").drop(_SRC)


def last_value(
    windows: DataFrame, df: DataFrame, spec: PanelSpec, name: str = "naive", cutoffs: Sequence[int] | None = None
) -> DataFrame:
    """Last train value held flat. Known ``cutoffs`` reduce the history to those positions before the join."""
    positions = None if cutoffs is None else F.col(spec.index).isin([int(c) - 1 for c in cutoffs])
    return _lookup(windows.withColumn(_SRC, F.col("cutoff") - 1), df, spec, name, positions)


def seasonal_naive(
    windows: DataFrame, df: DataFrame, spec: PanelSpec, season: int | None = None, name: str = "seasonal_naive",
    cutoffs: Sequence[int] | None = None,
) -> DataFrame:
    """Last full season tiled; a shorter history tiles what exists, an empty one gives 0."""
    s = spec.season if season is None else season
    period = F.least(F.lit(s).cast("long"), F.col("cutoff"))
    src = F.col("cutoff") - period + F.pmod(F.col("step") - 1, F.nullif(period, F.lit(0)))
    i = F.col(spec.index)
    positions = None if cutoffs is None else (i >= min(cutoffs) - s) & (i < max(cutoffs))
    out = _lookup(windows.withColumn(_SRC, src), df, spec, name, positions)
    return out.withColumn(name, F.when(F.col("cutoff") <= 0, F.lit(0.0)).otherwise(F.col(name)))


def all_phases_seen(df: DataFrame, spec: PanelSpec, cut: int, season: int) -> bool:
    """Whether every series has an observed value in every phase before the cutoff: then no mean is missing."""
    i, y = F.col(spec.index), F.col(spec.target)
    phase = F.when((i < cut) & y.isNotNull(), F.pmod(i, F.lit(season)))
    return df.groupBy(spec.id).agg(F.size(F.collect_set(phase)).alias("n")).filter(F.col("n") < season).isEmpty()


def seasonal_mean(
    windows: DataFrame, df: DataFrame, spec: PanelSpec, cutoffs: Sequence[int], season: int | None = None, name: str = "seasonal_mean"
) -> DataFrame:
    """Mean per (series, phase) before the cutoff; the phase runs on across it.

    Sums are taken once per (series, phase, stretch between cutoffs) and only those are accumulated
    per cutoff. A phase never seen takes the median of all train rows of that cutoff.
    """
    s = spec.season if season is None else season
    cuts = sorted(int(c) for c in cutoffs)
    marks = F.array(*(F.lit(c).cast("long") for c in cuts))
    i, y = F.col(spec.index), F.col(spec.target)
    parts = (
        df.filter(i < cuts[-1])
        .groupBy(spec.id, F.pmod(i, F.lit(s)).alias("_phase"), F.size(F.filter(marks, lambda c: c <= i)).alias("_z"))
        .agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    )
    later = F.slice(marks, F.col("_z") + 1, F.lit(len(cuts)))
    table = (
        parts.withColumn("cutoff", F.explode(later))
        .groupBy(spec.id, "_phase", "cutoff")
        .agg(ratio(F.sum("_s"), F.sum("_n").cast("double")).alias(name))
    )
    out = windows.withColumn("_phase", F.pmod(F.col("cutoff") + F.col("step") - 1, F.lit(s)))
    out = out.join(table, [spec.id, "_phase", "cutoff"], "left").drop("_phase")
    if all_phases_seen(df, spec, cuts[0], s):
        return out
    train = df.withColumn("cutoff", F.explode(F.filter(marks, lambda c: c > i)))
    middle = quantiles.grouped(train, ["cutoff"], {"_mid": (spec.target, 0.5)}, bounded=False, few_keys=True)
    return out.join(F.broadcast(middle), "cutoff", "left").withColumn(name, F.coalesce(F.col(name), F.col("_mid"))).drop("_mid")


def baseline_cube(df: DataFrame, spec: PanelSpec, cutoffs: Sequence[int], horizon: int | None = None) -> DataFrame:
    """Prediction cube of the three baselines: id, time, cutoff, step, blk, y and one column each.

    ``blk`` counts inside the scored block and is negative in the gap.
    """
    h = spec.full_horizon if horizon is None else horizon
    rows = df.select(spec.id, spec.time, spec.index, spec.target)
    if spec.bounded and min(cutoffs) >= spec.season and all_phases_seen(rows, spec, min(cutoffs), spec.season):
        out = _one_pass(rows, spec, cutoffs, h)
    else:
        out = last_value(horizons(rows, spec, cutoffs, h), df, spec, cutoffs=cutoffs)
        out = seasonal_naive(out, df, spec, cutoffs=cutoffs)
        out = seasonal_mean(out, df, spec, cutoffs)
    return out.withColumn("blk", F.col("step") - 1 - (h - spec.score_len))


def _one_pass(rows: DataFrame, spec: PanelSpec, cutoffs: Sequence[int], h: int) -> DataFrame:
    """All baselines from one shuffle by series and no join, for series that fit a partition.

    Inside a (series, phase) the value one season back is the previous row and the mean up to a
    cutoff is a running sum that many rows back, so a lag by whole seasons reads both.
    """
    i, y, s = F.col(spec.index), F.col(spec.target), spec.season
    back = range(1, -(-h // s) + 1)
    phase = Window.partitionBy(spec.id, "_phase").orderBy(spec.index)
    upto = phase.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.repartition(spec.id).withColumn("_phase", F.pmod(i, F.lit(s)))
    out = out.withColumns({"_cs": F.sum(y).over(upto), "_cn": F.count(y).over(upto)})
    out = out.withColumns(
        {
            "_past": F.array(
                *(
                    F.struct(F.lag(y, k).over(phase).alias("v"), F.lag("_cs", k).over(phase).alias("s"), F.lag("_cn", k).over(phase).alias("n"))
                    for k in back
                )
            )
        }
    )
    series = Window.partitionBy(spec.id)
    marks = {c: F.max(F.when(i == c - 1, y)).over(series) for c in cutoffs}
    windows = F.array(*(F.struct(F.lit(int(c)).cast("long").alias("c"), x.alias("last")) for c, x in marks.items()))
    out = out.withColumn("_w", windows).filter(i >= min(cutoffs))
    out = out.withColumn("_w", F.explode(F.filter("_w", lambda w: (i >= w["c"]) & (i < w["c"] + h))))
    at = F.get("_past", F.floor((i - F.col("_w.c")) / s).cast("int"))
    return out.select(
        spec.id, spec.time, spec.index, spec.target, F.col("_w.c").alias("cutoff"), (i - F.col("_w.c") + 1).alias("step"),
        F.col("_w.last").alias("naive"), at["v"].alias("seasonal_naive"),
        ratio(at["s"], at["n"].cast("double")).alias("seasonal_mean"),
    )
