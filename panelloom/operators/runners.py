"""Registry of members: what each can do, checked before anything is computed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators import baselines, impute, provenance
from panelloom.operators.assembly import with_labels
from panelloom.operators.evaluate import validate_prediction
from panelloom.operators.index import BLOCKS, horizons, select_horizon
from panelloom.operators.members import TreeConfig, fit_gapped, forecast_gapped, ridge_control, symmetric_config
from panelloom.spec import PanelSpec

KINDS = ("baseline", "tree", "linear", "residual")


@dataclass(frozen=True)
class Context:
    """One (member, window) unit of work; ``df`` is imputed on the window's own train rows."""

    df: DataFrame
    spec: PanelSpec
    cut: int
    seed: int | None = None
    gap_cov: str = "impute"
    gap_fill: str = "median"
    regime: str = "far"
    provenance: DataFrame | None = None
    config: TreeConfig = TreeConfig()


@dataclass(frozen=True)
class Member:
    name: str
    kind: str
    run: Callable[[Context], DataFrame]
    seedable: bool = False
    honours_gap_cov: bool = False
    channels: tuple[str, ...] = field(default_factory=tuple)
    status: str = "measured"


REGISTRY: dict[str, Member] = {}


def register(member: Member) -> Member:
    if member.name in REGISTRY:
        raise ValueError(f"member {member.name!r} is already registered")
    if member.kind not in KINDS:
        raise ValueError(f"member {member.name!r}: unknown kind {member.kind!r}")
    REGISTRY[member.name] = member
    return member


def available(kind: str | None = None, status: str | None = None) -> list[str]:
    return sorted(n for n, m in REGISTRY.items() if kind in (None, m.kind) and status in (None, m.status))


def check(member: Member, ctx: Context) -> None:
    """Refuse what the member cannot honour instead of dropping it silently."""
    if ctx.seed is not None and not member.seedable:
        raise ValueError(f"member {member.name!r} is deterministic: a seed would fabricate a spread")
    if ctx.gap_cov not in ("impute", "real"):
        raise ValueError(f"gap_cov must be 'impute' or 'real', got {ctx.gap_cov!r}")
    if ctx.regime not in BLOCKS:
        raise ValueError(f"regime must be one of {BLOCKS}, got {ctx.regime!r}")
    if ctx.gap_fill != "median" and not (member.honours_gap_cov and ctx.gap_cov == "impute"):
        raise ValueError(f"gap_fill={ctx.gap_fill!r} would never reach member {member.name!r}")
    impute.resolve(ctx.gap_fill, impute.GAP)
    if ctx.regime == "near" and ctx.gap_cov == "impute" and member.honours_gap_cov:
        raise ValueError("regime='near' with withheld covariates scores the rows that were withheld")
    for channel in member.channels:
        if channel not in ctx.df.columns:
            raise ValueError(f"member {member.name!r} needs channel {channel!r}, which the frame lacks")
        provenance.check_honest(ctx.provenance, channel, ctx.cut, ctx.spec.full_horizon)


def run_member(name: str, ctx: Context) -> DataFrame:
    """Validated cube of one member over one window: id, time, cutoff, step, y and the member's column."""
    if name not in REGISTRY:
        raise KeyError(f"unknown member {name!r}; registered: {available()}")
    member = REGISTRY[name]
    check(member, ctx)
    block = select_horizon(member.run(ctx), ctx.spec, ctx.regime)
    keys = [ctx.spec.id, ctx.spec.time, "cutoff", "step"]
    return validate_prediction(with_labels(block.select(*keys, name), ctx.df, ctx.spec), ctx.spec, name)


def _withheld(ctx: Context) -> DataFrame:
    """The frame a covariate member sees: the gap's signals reconstructed from the train rows."""
    spec, i = ctx.spec, F.col(ctx.spec.index)
    if ctx.gap_cov == "real":
        return ctx.df
    history, future = ctx.df.filter(i < ctx.cut), ctx.df.filter((i >= ctx.cut) & (i < ctx.cut + spec.full_horizon))
    return history.unionByName(
        impute.withhold_gap(future, history, spec, spec.score_len, spec.signals, strategy=ctx.gap_fill)
    )


def _baseline(fn: Callable[[DataFrame, Context], DataFrame]):
    def run(ctx: Context) -> DataFrame:
        rows = horizons(ctx.df.select(ctx.spec.id, ctx.spec.time, ctx.spec.index), ctx.spec, [ctx.cut])
        return fn(rows, ctx)

    return run


def _tree(name: str, symmetric: bool = False, **changes):
    def run(ctx: Context) -> DataFrame:
        seed = ctx.config.seed if ctx.seed is None else ctx.seed
        config = replace(symmetric_config(ctx.config) if symmetric else ctx.config, **changes, seed=seed)
        frame = _withheld(ctx)
        member = fit_gapped(frame, ctx.spec, ctx.cut, config)
        return forecast_gapped(frame, ctx.spec, member, name)

    return run


def _ridge(ctx: Context) -> DataFrame:
    return ridge_control(_withheld(ctx), ctx.spec, ctx.cut, ctx.spec.full_horizon, ctx.spec.signals)


register(Member("naive", "baseline", _baseline(lambda r, c: baselines.last_value(r, c.df, c.spec, cutoffs=[c.cut]))))
register(Member("seasonal_naive", "baseline", _baseline(lambda r, c: baselines.seasonal_naive(r, c.df, c.spec, cutoffs=[c.cut]))))
register(Member("seasonal_mean", "baseline", _baseline(lambda r, c: baselines.seasonal_mean(r, c.df, c.spec, [c.cut]))))
register(Member("tree", "tree", _tree("tree"), seedable=True, honours_gap_cov=True))
register(Member("tree_unit", "tree", _tree("tree_unit", unit=True), seedable=True, honours_gap_cov=True))
register(Member("tree_level", "tree", _tree("tree_level", by_level=True), seedable=True, honours_gap_cov=True))
register(Member("tree_symmetric", "tree", _tree("tree_symmetric", symmetric=True), seedable=True, honours_gap_cov=True))
register(Member("ridge", "linear", _ridge, honours_gap_cov=True))


