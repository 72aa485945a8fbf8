"""Row selection on the panel: positions, windows, blocks, regimes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import ordered
from panelloom.functions.exprs import clip
from panelloom.spec import PanelSpec

REGIMES = ("full", "late")
HORIZONS = ("near", "far", "all")
BLOCKS = ("far", "near")


def _require(value: str, allowed: Sequence[str], what: str) -> None:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {tuple(allowed)}, got {value!r}")


def add_index(df: DataFrame, spec: PanelSpec, name: str | None = None) -> DataFrame:
    return ordered.row_index(df, spec, name)


def gapped_horizon(df: DataFrame, spec: PanelSpec, cut: int, horizon: int | None = None) -> DataFrame:
    """Half-open window ``[cut, cut+horizon)``; never 'every row after the cut'."""
    h = spec.full_horizon if horizon is None else horizon
    i = F.col(spec.index)
    return df.filter((i >= cut) & (i < cut + h))


def horizons(df: DataFrame, spec: PanelSpec, cutoffs: Sequence[int], horizon: int | None = None) -> DataFrame:
    """All windows at once: one row per (cutoff, series, position) with ``step`` counted from 1."""
    h = spec.full_horizon if horizon is None else horizon
    i = F.col(spec.index)
    # The outer bounds reach the scan; only rows inside some window are tested against each of them.
    df = df.filter((i >= min(cutoffs)) & (i < max(cutoffs) + h))
    if len(cutoffs) == 1:
        out = df.withColumn("cutoff", F.lit(int(cutoffs[0])).cast("long"))
    else:
        cuts = F.array(*(F.lit(int(c)).cast("long") for c in cutoffs))
        out = df.withColumn("cutoff", F.explode(F.filter(cuts, lambda c: (i >= c) & (i < c + h))))
    return out.withColumn("step", (i - F.col("cutoff") + 1).cast("long"))


def take_block(df: DataFrame, spec: PanelSpec, regime: str = "far", length: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The last (far) or first (near) ``length`` rows of each series."""
    _require(regime, BLOCKS, "regime")
    n = spec.score_len if length is None else length
    keys = [*by, spec.id]
    edge = F.max if regime == "far" else F.min
    ends = df.groupBy(*keys).agg(edge(spec.index).alias("_edge"))
    i, e = F.col(spec.index), F.col("_edge")
    inside = i > e - n if regime == "far" else i < e + n
    return df.join(ends, keys).filter(inside).drop("_edge")


def add_block_index(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """``blk``: 0-based position inside each (cutoff, series) block."""
    keys = [c for c in ("cutoff",) if c in df.columns]
    return ordered.row_index(df, spec, "blk", by=keys)


def select_regime(df: DataFrame, spec: PanelSpec, regime: str) -> DataFrame:
    _require(regime, REGIMES, "regime")
    if regime == "full":
        return df
    if "blk" not in df.columns:
        df = add_block_index(df, spec)
    return df.filter(F.col("blk") >= spec.late_from)


def select_horizon(df: DataFrame, spec: PanelSpec, horizon: str) -> DataFrame:
    _require(horizon, HORIZONS, "horizon")
    if horizon == "all":
        return df
    if "step" not in df.columns:
        raise KeyError(f"horizon={horizon!r} needs a 'step' column")
    near = F.col("step") <= spec.score_len
    return df.filter(near if horizon == "near" else ~near)


def common_length(df: DataFrame, spec: PanelSpec) -> int:
    """Rows of every series; series that end at different positions have no common cut and are refused."""
    ends = df.groupBy(spec.id).agg(F.max(spec.index).alias("end")).agg(F.min("end").alias("lo"), F.max("end").alias("hi")).first()
    if ends["lo"] != ends["hi"]:
        raise ValueError(f"series end at different positions ({ends['lo']} to {ends['hi']}): split each at its own tail")
    return ends["hi"] + 1


def split_horizon(df: DataFrame, spec: PanelSpec, horizon: int) -> int:
    """The block length a panel of ragged series allows (one number read on the driver); for small fixtures."""
    lengths = df.groupBy(spec.id).agg(F.count(F.lit(1)).alias("n"))
    shortest = lengths.agg(F.min("n")).first()[0]
    return horizon if shortest >= 2 * horizon + 16 else max(2, (shortest - 16) // 2)


def gapped_split(df: DataFrame, spec: PanelSpec, horizon: int, shrink: bool = False) -> DataFrame:
    """Tag each row ``train``, ``gap`` or ``score`` from the tail of its own series.

    Adds ``part``, ``is_scored`` and ``step`` (1-based inside gap + score, NULL in train). Too short a
    series is refused; with ``shrink`` the horizon follows the shortest one instead.
    """
    h = split_horizon(df, spec, horizon)
    if h != horizon and not shrink:
        raise ValueError(f"the shortest series allows a horizon of {h}, not {horizon}")
    out = df if spec.index in df.columns else add_index(df, spec)
    ends = out.groupBy(spec.id).agg((F.max(spec.index) - 2 * h + 1).alias("_cut"))
    at = F.col(spec.index) - F.col("_cut")
    return (
        out.join(ends, spec.id)
        .withColumn("part", F.when(at < 0, "train").when(at < h, "gap").otherwise("score"))
        .withColumn("is_scored", at >= h)
        .withColumn("step", F.when(at >= 0, at + 1))
        .drop("_cut")
    )


def compose_columns(
    calendar: Sequence[str], signals: Sequence[str], flags: Sequence[str] = (), channels: Sequence[str] = (), aggregates: Sequence[str] = ()
) -> list[str]:
    """Ordered conditioning set; opt-in groups come last, a name may occur once."""
    cols = [*calendar, *signals, *flags, *channels, *aggregates]
    twice = sorted({c for c in cols if cols.count(c) > 1})
    if twice:
        raise ValueError(f"columns declared twice: {twice}")
    return cols


def leftover_columns(declared: Sequence[str], known: Sequence[str]) -> list[str]:
    """Aggregate columns found by elimination: declared names that belong to no other role."""
    taken = set(known)
    return [c for c in declared if c not in taken]


def bag_columns(columns: Sequence[str], model: str) -> list[str]:
    """``model``, ``model1``, ``model2`` ... in numeric order; suffixed names such as quantiles are out."""
    pattern = re.compile(re.escape(model) + r"(\d*)")
    hits = {c: m for c in columns if (m := pattern.fullmatch(c))}
    return sorted(hits, key=lambda c: int(hits[c].group(1) or 0))


def first_series(df: DataFrame, spec: PanelSpec, n: int) -> DataFrame:
    """Rows of the first ``n`` series in id order."""
    ids = df.select(spec.id).distinct().orderBy(spec.id).limit(n)
    return df.join(ids, spec.id, "left_semi")


def finite_or(x: Column, fallback: Column | float) -> Column:
    fb = fallback if isinstance(fallback, Column) else F.lit(fallback)
    bad = F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return F.coalesce(F.when(~bad, x), fb)


def guard_predictions(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Clip at zero, then replace missing or non-finite values by the median of the clipped column."""
    from panelloom.functions.quantiles import pooled

    clean = df.withColumn("_p", clip(finite_or(F.col(col), F.lit(None).cast("double")), low=0.0))
    middle = pooled(clean, ["_p"])["_p"]
    return clean.withColumn(out or col, F.coalesce(F.col("_p"), F.lit(middle))).drop("_p")


def trim_to_patches(df: DataFrame, spec: PanelSpec, patch: int) -> DataFrame:
    """Drop the oldest ``n % patch`` rows of each series; a context under one patch is refused."""
    sizes = df.groupBy(spec.id).agg(F.count(F.lit(1)).alias("_n"), F.min(spec.index).alias("_first"))
    short = sizes.filter(F.col("_n") < patch).count()
    if short:
        raise ValueError(f"{short} series hold less than one patch of {patch} rows")
    drop = F.pmod(F.col("_n"), F.lit(patch))
    return df.join(sizes, spec.id).filter(F.col(spec.index) >= F.col("_first") + drop).drop("_n", "_first")


MODES = ("gapped-real", "gapped-withheld", "contiguous")


def check_mode(mode: str, regime: str) -> None:
    _require(mode, MODES, "mode")
    _require(regime, BLOCKS, "regime")
    if regime == "near" and mode != "gapped-real":
        raise ValueError(f"regime='near' is meaningless under mode={mode!r}: it is the same block, or the withheld one")


def mode_rows(df: DataFrame, spec: PanelSpec, mode: str, cut: int, regime: str = "far") -> DataFrame:
    """The scored rows of an evaluation mode: a block across a gap, or directly after the train end."""
    check_mode(mode, regime)
    if mode == "contiguous":
        return gapped_horizon(df, spec, cut + spec.score_len, spec.score_len).withColumn("mode", F.lit(mode))
    start = cut + (spec.score_len if regime == "far" else 0)
    return gapped_horizon(df, spec, start, spec.score_len).withColumn("mode", F.lit(mode))


def canonical(df: DataFrame, spec: PanelSpec) -> DataFrame:
    keys = [c for c in ("cutoff",) if c in df.columns]
    return df.orderBy(*keys, spec.id, spec.time)


def ranked_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per key of a small report table, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long")).filter(F.col(name) <= n)
