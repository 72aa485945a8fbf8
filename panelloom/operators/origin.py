"""Rolling-origin forecast blocks: the block grid, honest splicing, and pluggable forecasters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators import baselines
from panelloom.operators.index import gapped_horizon
from panelloom.spec import PanelSpec

Block = tuple[int, int]


def block_starts(n: int, block: int) -> list[int]:
    """Starts rolled back from the train end; what is left in front is warm-up."""
    return list(range(n - block, 0, -block))


def rolling_windows(df: DataFrame, spec: PanelSpec, n: int, block: int) -> DataFrame:
    """Each train row with the block that forecasts it: ``cutoff`` is the block start.

    A row belongs to exactly one block, so the grid is arithmetic and nothing is multiplied.
    """
    i = F.col(spec.index)
    start = F.lit(n) - F.ceil((F.lit(n) - i) / F.lit(block)) * F.lit(block)
    return (
        df.filter(i < n)
        .withColumn("cutoff", start.cast("long"))
        .filter(F.col("cutoff") > 0)
        .withColumn("step", (i - F.col("cutoff") + 1).cast("long"))
    )


def horizon_window(df: DataFrame, spec: PanelSpec, cut: int, horizon: int) -> DataFrame:
    """The single block anchored at the cutoff."""
    out = gapped_horizon(df, spec, cut, horizon).withColumn("cutoff", F.lit(cut).cast("long"))
    return out.withColumn("step", (F.col(spec.index) - F.col("cutoff") + 1).cast("long"))


NATIVE = ("naive", "seasonal_naive", "seasonal_mean")


def forecast_native(windows: DataFrame, df: DataFrame, spec: PanelSpec, cutoffs: Sequence[int], method: str, name: str) -> DataFrame:
    """One of the baselines as the block forecaster, clipped at zero."""
    if method not in NATIVE:
        raise KeyError(f"unknown forecaster {method!r}; have {NATIVE}")
    if method == "naive":
        out = baselines.last_value(windows, df, spec, name, cutoffs)
    elif method == "seasonal_naive":
        out = baselines.seasonal_naive(windows, df, spec, name=name, cutoffs=cutoffs)
    else:
        out = baselines.seasonal_mean(windows, df, spec, cutoffs, name=name)
    return out.withColumn(name, F.greatest(F.lit(0.0), F.col(name)))


def roll_train(df: DataFrame, spec: PanelSpec, n: int, block: int, method: str = "seasonal_naive", name: str = "channel") -> tuple[DataFrame, list[Block]]:
    """Out-of-fold channel over the train region and the blocks it came from."""
    starts = block_starts(n, block)
    rows = rolling_windows(df.select(spec.id, spec.time, spec.index), spec, n, block)
    return forecast_native(rows, df, spec, starts, method, name), [(s, block) for s in starts]


def forecast_horizon(df: DataFrame, spec: PanelSpec, cut: int, horizon: int, method: str = "seasonal_naive", name: str = "channel") -> tuple[DataFrame, list[Block]]:
    rows = horizon_window(df.select(spec.id, spec.time, spec.index), spec, cut, horizon)
    return forecast_native(rows, df, spec, [cut], method, name), [(cut, horizon)]


# A forecaster gets one context per call: values in time order and the number of steps, and for the
# covariate-aware form the covariates of context and future. It returns that many numbers.
Forecaster = Callable[[np.ndarray, int], np.ndarray]
CovariateForecaster = Callable[[pd.DataFrame, pd.DataFrame, int], np.ndarray]


def forecast_blocks(
    df: DataFrame,
    spec: PanelSpec,
    blocks: Sequence[Block],
    forecaster: Forecaster | CovariateForecaster,
    name: str = "channel",
    *,
    covariates: Sequence[str] = (),
    context_rows: int | None = None,
) -> DataFrame:
    """Run a Python forecaster for every (series, block): each call sees the whole history before its block.

    A row is sent only to the blocks whose context or horizon holds it, and a group is one block of
    one series. A forecaster that can only use so many rows says so by ``context_rows``; then a group
    is that many rows plus the block length whatever the series length.
    """
    covs = list(covariates)
    table = F.array(
        *(F.struct(F.lit(int(s)).cast("long").alias("s"), F.lit(int(n)).cast("long").alias("n")) for s, n in blocks)
    )
    i = F.col(spec.index)
    held = F.filter(table, lambda b: (F.lit(True) if context_rows is None else i >= b["s"] - context_rows) & (i < b["s"] + b["n"]))
    rows = df.select(spec.id, spec.time, spec.index, spec.target, *covs).withColumn("_b", F.explode(held))
    rows = rows.withColumn("cutoff", F.col("_b.s")).withColumn("_len", F.col("_b.n")).drop("_b")
    # The target of the forecast rows never reaches Python.
    rows = rows.withColumn(spec.target, F.when(i < F.col("cutoff"), F.col(spec.target)))
    idc, tc, yc, ic = spec.id, spec.time, spec.target, spec.index

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ic)
        start, length = int(pdf["cutoff"].iloc[0]), int(pdf["_len"].iloc[0])
        context, future = pdf[pdf[ic] < start], pdf[pdf[ic] >= start]
        if covs and len(future) < length:
            raise ValueError(f"block {start}: {len(future)} future covariate rows for {length} steps")
        if covs:
            values = forecaster(context[[yc, *covs]], future[covs], length)
        else:
            values = forecaster(context[yc].to_numpy(float), length)
        values = np.asarray(values, float)
        if values.shape != (length,):
            raise ValueError(f"block {start}: forecaster returned shape {values.shape}, expected ({length},)")
        out = future[[idc, tc, ic, "cutoff"]].copy()
        out[name] = np.clip(values[out[ic].to_numpy() - start], 0.0, None)
        return out

    fields = dict(df.dtypes)
    schema = f"{idc} {fields[idc]}, {tc} {fields[tc]}, {ic} long, cutoff long, {name} double"
    return rows.groupBy(idc, "cutoff").applyInPandas(one, schema)


# ---------------------------------------------------------------- splicing an honest horizon


def kept_blocks(blocks: Sequence[Block], cut: int) -> list[Block]:
    """Blocks whose context ends at or before the cutoff."""
    return sorted((int(s), int(n)) for s, n in blocks if s <= cut)


def stale_range(blocks: Sequence[Block], cut: int, horizon: int, n_hours: int) -> Block:
    """Half-open range of horizon positions no kept block covers; empty when the ends meet."""
    covered_to = max((s + n for s, n in kept_blocks(blocks, cut) if s + n > cut), default=cut)
    end = min(cut + horizon, n_hours)
    return (covered_to, end) if covered_to < end else (cut + horizon, cut + horizon)


def rehost(base: DataFrame, spec: PanelSpec, blocks: Sequence[Block], cut: int, horizon: int, n_hours: int, column: str, fresh: Callable[[int, int], DataFrame]) -> tuple[DataFrame, list[Block]]:
    """Keep what is honest for this cutoff and replace only the stale range by one new block.

    ``fresh(cut, horizon)`` is called only when something is stale; it returns id, time, ``column``.
    """
    lo, hi = stale_range(blocks, cut, horizon, n_hours)
    kept = kept_blocks(blocks, cut)
    if lo >= hi:
        return base, kept
    new = fresh(cut, horizon).select(spec.id, spec.time, F.col(column).alias("_new"))
    stale = (F.col(spec.index) >= lo) & (F.col(spec.index) < hi)
    out = base.join(new, [spec.id, spec.time], "left").withColumn(
        column, F.when(stale, F.col("_new")).otherwise(F.col(column))
    )
    return out.drop("_new"), [*kept, (cut, horizon)]


def contiguous_windows(df: DataFrame, spec: PanelSpec, n_windows: int, length: int, end: int) -> DataFrame:
    """Rolling folds without a gap: the last ``n_windows`` blocks of ``length`` rows before ``end``."""
    i = F.col(spec.index)
    fold = F.floor((F.lit(end) - 1 - i) / F.lit(length))
    return (
        df.filter((i < end) & (i >= end - n_windows * length))
        .withColumn("cutoff", (F.lit(end) - (fold + 1) * F.lit(length)).cast("long"))
        .withColumn("step", (i - F.col("cutoff") + 1).cast("long"))
    )
