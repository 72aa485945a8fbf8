"""Cross-series and per-series feature blocks: ``block(df, spec, ...) -> (df, new column names)``.

Aggregates must be built after imputation and on history and horizon joined: a missing value or a
frame cut at the origin would change them without any error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import crosssection as xs
from panelloom.functions import linkage, ordered, quantiles, spectral
from panelloom.functions.exprs import ratio
from panelloom.operators.impute import MISSING
from panelloom.session import checkpointed
from panelloom.spec import PanelSpec

Built = tuple[DataFrame, list[str]]


def zone_labels(statics: DataFrame, spec: PanelSpec, sin: str = "zone_sin", cos: str = "zone_cos") -> DataFrame:
    """Zone number per series from its distinct (sin, cos) pair, rounded half-even to 6 digits."""
    pairs = statics.select(spec.id, F.bround(sin, 6).alias("_s"), F.bround(cos, 6).alias("_c"))
    # One row per zone: the numbering window runs over the distinct pairs only.
    codes = pairs.select("_s", "_c").distinct()
    codes = codes.withColumn("zone", F.row_number().over(Window.orderBy("_s", "_c")) - 1)
    return pairs.join(codes, ["_s", "_c"]).select(spec.id, F.col("zone").cast("long").alias("zone"))


def _system_and_zone(df: DataFrame, spec: PanelSpec, cols: Sequence[str], prefix: str) -> Built:
    sums = {c: (F.sum(c), F.count(c)) for c in cols}
    # Zone sums first; the system mean is rolled up from them, so the panel is aggregated once.
    zone = xs.system(
        df, spec, {k: x for c, (s, n) in sums.items() for k, x in ((f"_s_{c}", s), (f"_n_{c}", n))}, [spec.zone]
    )
    total = zone.groupBy(spec.index).agg(
        *(ratio(F.sum(f"_s_{c}"), F.sum(f"_n_{c}").cast("double")).alias(f"{prefix}_sys_{c}") for c in cols)
    )
    per_zone = zone.select(
        spec.index, spec.zone, *(ratio(F.col(f"_s_{c}"), F.col(f"_n_{c}").cast("double")).alias(f"{prefix}_zone_{c}") for c in cols)
    )
    out = xs.attach(df, per_zone.join(total, spec.index), spec, [spec.zone])
    return out, [n for c in cols for n in (f"{prefix}_sys_{c}", f"{prefix}_zone_{c}")]


def system_zone_means(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> Built:
    return _system_and_zone(df, spec, cols, "xs")


def system_zone_means_refilled(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> Built:
    return _system_and_zone(df, spec, cols, "xs2")


def leave_one_out(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> Built:
    """Mean of everybody else: (sum - own) / (n - 1), n being all series."""
    out = xs.spread_back(df, spec, {**{f"_t_{c}": F.sum(c) for c in cols}, "_n": F.count(F.lit(1))})
    names = [f"xs_loo_{c}" for c in cols]
    out = out.withColumns(
        {n: ratio(F.coalesce(F.col(f"_t_{c}"), F.lit(0.0)) - F.col(c), (F.col("_n") - 1).cast("double")) for n, c in zip(names, cols)}
    )
    return out.drop("_n", *(f"_t_{c}" for c in cols)), names


def shares_and_ranks(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> Built:
    """Share of the total at the position (NULL near a zero total) and percentile rank with average ties."""
    out = xs.spread_back(df, spec, {f"_t_{c}": F.sum(c) for c in cols})
    out = out.withColumns(
        {f"xs_share_{c}": F.when(F.abs(f"_t_{c}") >= 1e-9, F.col(c) / F.col(f"_t_{c}")) for c in cols}
    ).drop(*(f"_t_{c}" for c in cols))
    out = quantiles.average_ranks(out, [spec.id, spec.index], [spec.index], {c: f"xs_rank_{c}" for c in cols}, few_keys=spec.bounded)
    return out, [n for c in cols for n in (f"xs_share_{c}", f"xs_rank_{c}")]


def dispersion(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> Built:
    """Sample standard deviation and the 10-90 % range across series."""
    std = xs.system(df, spec, {f"xs_std_{c}": F.stddev_samp(c) for c in cols})
    wanted = {f"{t}_{c}": (c, p) for c in cols for t, p in (("_hi", 0.9), ("_lo", 0.1))}
    rng = quantiles.grouped(df, [spec.index], wanted, bounded=False, few_keys=spec.bounded)
    rng = rng.select(spec.index, *((F.col(f"_hi_{c}") - F.col(f"_lo_{c}")).alias(f"xs_rng_{c}") for c in cols))
    out = xs.attach(df, std.join(rng, spec.index, "left"), spec)
    return out, [n for c in cols for n in (f"xs_std_{c}", f"xs_rng_{c}")]


def missingness(df: DataFrame, spec: PanelSpec, flags: Sequence[str], shown: int | None = None) -> Built:
    """Share of series whose flag is up, for every flag (or the first ``shown``) and for any flag at all."""
    flags = list(flags)
    some = F.greatest(*flags) if len(flags) > 1 else F.col(flags[0])
    aggs = {f"xs_miss_{f}": F.avg(f) for f in flags[:shown]}
    aggs["xs_miss_any_frac"] = F.avg(some)
    return xs.spread_back(df, spec, aggs), list(aggs)


def rolling_system(df: DataFrame, spec: PanelSpec, cols: Sequence[str], widths: Sequence[int] = (3, 6, 12, 24)) -> Built:
    table = xs.system(df, spec, {f"_m_{c}": F.avg(c) for c in cols})
    means = {f"xs_roll{w}_{c}": (F.col(f"_m_{c}"), w) for c in cols for w in widths}
    table = ordered.rolling_mean(table, spec, means, centred=True, keys=()).drop(*(f"_m_{c}" for c in cols))
    return xs.attach(df, table, spec), list(means)


def learned_groups(df: DataFrame, spec: PanelSpec, cut: int, k: int = 8) -> DataFrame:
    """Partition of the series by target correlation on the train region: (id, cluster).

    Average linkage on one minus the correlation, cut at ``k`` groups, numbered by their smallest id. A series without
    variation has correlation zero with every other.
    """
    return linkage.linked_groups(df.filter(F.col(spec.index) < cut), spec.id, spec.index, spec.target, k)


def learned_partition(df: DataFrame, spec: PanelSpec, cols: Sequence[str], cut: int, k: int = 8, groups: DataFrame | None = None) -> Built:
    """Means over the learned groups; ``groups`` are those of :func:`learned_groups` where they are known."""
    grouped = df.join(learned_groups(df, spec, cut, k) if groups is None else groups, spec.id, "left")
    out = xs.spread_back(grouped, spec, {f"xs_clu_{c}": F.avg(c) for c in cols}, ["cluster"])
    return out.drop("cluster"), [f"xs_clu_{c}" for c in cols]


def capacity_weighted(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> Built:
    """Capacity-weighted system mean; NULL where any series is missing, since the weights must all count."""
    cap = F.col(spec.capacity)
    names = [f"xs_cap_{c}" for c in cols]
    aggs = {
        n: F.when(F.count(c) == F.count(F.lit(1)), ratio(F.sum(F.col(c) * cap), F.sum(cap))) for n, c in zip(names, cols)
    }
    return xs.spread_back(df, spec, aggs), names


def lagged_system_target(df: DataFrame, spec: PanelSpec, widths: Sequence[int] = (24, 168), shift: int | None = None) -> Built:
    """Trailing means of the system target, shifted a full horizon so that any origin may read them."""
    shift = spec.full_horizon if shift is None else shift
    table = xs.system(df, spec, {"_m": F.avg(spec.target)})
    means = {f"_r{w}": (F.col("_m"), w) for w in widths}
    table = ordered.rolling_mean(table, spec, means, centred=False, keys=())
    table = ordered.lagged(table, spec, {f"xs_ytgt{w}": (F.col(f"_r{w}"), shift) for w in widths}, keys=())
    return xs.attach(df, table.drop("_m", *means), spec), [f"xs_ytgt{w}" for w in widths]


def system_leads_lags(df: DataFrame, spec: PanelSpec, cols: Sequence[str], shifts: Sequence[int] = (-24, 24, 168)) -> Built:
    table = xs.system(df, spec, {f"_m_{c}": F.avg(c) for c in cols})
    tag = {n: (f"lead{-n}" if n < 0 else f"lag{n}") for n in shifts}
    lags = {f"xs_{tag[n]}_{c}": (F.col(f"_m_{c}"), n) for c in cols for n in shifts}
    table = ordered.lagged(table, spec, lags, keys=()).drop(*(f"_m_{c}" for c in cols))
    return xs.attach(df, table, spec), list(lags)


def principal_components(df: DataFrame, spec: PanelSpec, cols: Sequence[str], cut: int, n_pc: int = 3) -> Built:
    """Scores of the first components of the [time x series] panel, fitted on the train region.

    The loadings are the leading vectors over the series of the train rows centred by series; the scores are one
    aggregation over series. Each component's sign is fixed by its largest loading, ties going to the smaller digest.
    """
    out, names = df, []
    i = F.col(spec.index)
    for c in cols:
        mean = df.filter(i < cut).groupBy(spec.id).agg(F.avg(c).alias("_mu"))
        centred = df.join(mean, spec.id).withColumn("_x", F.col(c) - F.col("_mu")).select(spec.id, spec.index, "_x")
        loads = checkpointed(spectral.leading_vectors(centred.filter((i < cut) & F.col("_x").isNotNull()), spec.id, spec.index, "_x", n_pc))
        largest = [F.sign(F.max_by(F.try_element_at("u", F.lit(j + 1)), F.struct(F.round(F.abs(F.try_element_at("u", F.lit(j + 1))), 9), F.crc32(spec.id)))).alias(f"_s{j}") for j in range(n_pc)]
        signs = loads.agg(*largest)
        wide = loads.crossJoin(F.broadcast(signs)).select(spec.id, *((F.try_element_at("u", F.lit(j + 1)) * F.col(f"_s{j}")).alias(f"_u{j}") for j in range(n_pc)))  # one row of signs
        scores = centred.join(wide, spec.id).groupBy(spec.index).agg(
            *(F.sum(F.col("_x") * F.col(f"_u{j}")).alias(f"xs_pc{j}_{c}") for j in range(n_pc))
        )
        out = xs.attach(out, scores, spec)
        names += [f"xs_pc{j}_{c}" for j in range(n_pc)]
    return out, names


def channel_consensus(df: DataFrame, spec: PanelSpec, channel: str, tag: str = "fc") -> Built:
    """System mean, zone mean and percentile rank of a stored forecast channel."""
    out, _ = _system_and_zone(df.withColumn(tag, F.col(channel)), spec, [tag], "xs")
    out = out.drop(tag)
    out = quantiles.average_rank(out, [spec.index], channel, f"xs_rank_{tag}", few_keys=spec.bounded)
    return out, [f"xs_sys_{tag}", f"xs_zone_{tag}", f"xs_rank_{tag}"]


def history_statics(
    df: DataFrame, spec: PanelSpec, cut: int, flags: Sequence[str] = (), day: int = 24, week: int = 168
) -> tuple[DataFrame, list[str]]:
    """Per-series whole-history statistics on the train region: one row per series."""
    y = F.col(spec.target)
    train = df.filter(F.col(spec.index) < cut)
    train = ordered.lagged(train, spec, {"_1": (y, 1), "_d": (y, day), "_w": (y, week)})
    wide = train.groupBy(spec.id).agg(
        F.avg(y).alias("_mu"),
        F.stddev_samp(y).alias("_sd"),
        F.var_samp(y).alias("_var"),
        F.avg(F.abs(y - F.col("_1"))).alias("_d1"),
        F.avg(F.abs(y - F.col("_w"))).alias("_dw"),
        F.var_samp(y - F.col("_w")).alias("_vw"),
        F.var_samp(y - F.col("_d")).alias("_vd"),
        F.max(spec.capacity).alias("_cap"),
        *(F.avg(f).alias(f"_f_{f}") for f in flags),
    )
    q = quantiles.grouped(train, [spec.id], {"_q1": (spec.target, 0.25), "_q3": (spec.target, 0.75)}, bounded=spec.bounded)
    mu = F.col("_mu")
    stats = {
        "xs_st_level": mu,
        "xs_st_std": F.col("_sd"),
        "xs_st_cv": ratio(F.col("_sd"), mu),
        "xs_st_iqr": ratio(F.col("_q3") - F.col("_q1"), mu),
        "xs_st_d1": ratio(F.col("_d1"), mu),
        f"xs_st_d{week}": ratio(F.col("_dw"), mu),
        f"xs_st_seas{week}": 1 - ratio(F.col("_vw"), F.col("_var")),
        f"xs_st_seas{day}": 1 - ratio(F.col("_vd"), F.col("_var")),
        "xs_st_util": ratio(mu, F.col("_cap")),
    }
    if flags:
        stats["xs_st_missrate"] = sum((F.col(f"_f_{f}") for f in flags), F.lit(0.0)) / len(flags)
    return wide.join(q, spec.id).select(spec.id, *(x.alias(n) for n, x in stats.items())), list(stats)


def behaviour_statics(df: DataFrame, spec: PanelSpec, cut: int, flags: Sequence[str] = (), day: int = 24, week: int = 168) -> Built:
    table, names = history_statics(df, spec, cut, flags, day, week)
    return df.join(table, spec.id, "left"), names


def hierarchical_target(df: DataFrame, spec: PanelSpec, shift: int | None = None, week: int = 168) -> Built:
    """Seasonal-naive value, drift and zone value of the aggregate target, a full horizon back."""
    shift = spec.full_horizon if shift is None else shift
    zone = xs.system(df, spec, {"_s": F.sum(spec.target), "_n": F.count(spec.target)}, [spec.zone])
    total = zone.groupBy(spec.index).agg(ratio(F.sum("_s"), F.sum("_n").cast("double")).alias("_m"))
    total = ordered.lagged(
        total, spec, {"xs_hier_sys": (F.col("_m"), shift), "_far": (F.col("_m"), shift + week)}, keys=()
    ).withColumn("xs_hier_drift", F.col("xs_hier_sys") - F.col("_far")).drop("_m", "_far")
    mean = ratio(F.col("_s"), F.col("_n").cast("double"))
    zone = ordered.lagged(zone, spec, {"xs_hier_zone": (mean, shift)}, keys=[spec.zone]).drop("_s", "_n")
    out = xs.attach(df, zone.join(total, spec.index), spec, [spec.zone])
    return out, ["xs_hier_sys", "xs_hier_drift", "xs_hier_zone"]


def centred_windows(df: DataFrame, spec: PanelSpec, cols: Sequence[str], widths: Sequence[int] = (3, 6, 12, 24)) -> Built:
    means = {f"cw{w}_{c}": (F.col(c), w) for c in cols for w in widths}
    return ordered.rolling_mean(df, spec, means, centred=True), list(means)


def climatology_table(df: DataFrame, spec: PanelSpec, cut: int) -> DataFrame:
    """Mean target per (series, phase) on the train region, with the mean over the bins and the rows."""
    phase = F.pmod(F.col(spec.index), F.lit(spec.season))
    bins = df.filter(F.col(spec.index) < cut).groupBy(spec.id, phase.alias("_phase")).agg(
        F.avg(spec.target).alias("_bin"), F.sum(spec.target).alias("_s"), F.count(spec.target).alias("_n")
    )
    level = bins.groupBy(spec.id).agg(
        F.avg("_bin").alias("_mean_bin"), ratio(F.sum("_s"), F.sum("_n").cast("double")).alias("_level")
    )
    return bins.select(spec.id, "_phase", "_bin"), level


def climatology(df: DataFrame, spec: PanelSpec, cut: int, *, shape: bool = False) -> Built:
    """The series' own mean at the matching phase; an unseen phase takes the mean of its bins."""
    bins, level = climatology_table(df, spec, cut)
    out = df.withColumn("_phase", F.pmod(F.col(spec.index), F.lit(spec.season)))
    out = out.join(level, spec.id, "left").join(bins, [spec.id, "_phase"], "left")
    out = out.withColumn("clim_how", F.coalesce(F.col("_bin"), F.col("_mean_bin")))
    names = ["clim_how"]
    if shape:
        out = out.withColumn("clim_how_shape", ratio(F.col("clim_how"), F.col("_level")))
        names.append("clim_how_shape")
    return out.drop("_phase", "_bin", "_mean_bin", "_level"), names


def backward_memory(df: DataFrame, spec: PanelSpec, cols: Sequence[str], halflives: Sequence[float]) -> Built:
    """Exponential memory of each signal up to the previous row; the first row is its own value."""
    med = quantiles.grouped(df, [spec.id], {f"_m_{c}": (c, 0.5) for c in cols}, bounded=spec.bounded)
    overall = quantiles.pooled(df, cols)
    out = df.join(med, spec.id, "left").withColumns(
        {f"_v_{c}": F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(overall[c])) for c in cols}
    )
    names = {f"ew_{c}_{h:g}": (c, h) for c in cols for h in halflives}
    out = ordered.ewma(out, spec, {f"_e_{n}": (F.col(f"_v_{c}"), float(h)) for n, (c, h) in names.items()})
    out = ordered.lagged(out, spec, {n: (F.col(f"_e_{n}"), 1) for n in names})
    out = out.withColumns({n: F.coalesce(F.col(n), F.col(f"_v_{c}")) for n, (c, _) in names.items()})
    return out.drop(*(f"{p}{c}" for c in cols for p in ("_m_", "_v_")), *(f"_e_{n}" for n in names)), list(names)


def compose(*builders: Callable[[DataFrame], Built]) -> Callable[[DataFrame], Built]:
    """Run several blocks one after another and return all their columns."""

    def build(df: DataFrame) -> Built:
        names: list[str] = []
        for b in builders:
            df, more = b(df)
            names += more
        return df, names

    return build


# ---------------------------------------------------------------- registry and attachment


@dataclass(frozen=True)
class Block:
    """A block bound to a panel: the columns it makes, and whether it is fitted on a train cut."""

    names: tuple[str, ...]
    build: Callable[[DataFrame], Built]
    fitted: bool = False


def registry(
    spec: PanelSpec,
    cut: int,
    *,
    live: Sequence[str],
    given: Sequence[str],
    refill: Sequence[str],
    memory: Sequence[str],
    asymmetric: Sequence[str],
    channel: str | None = None,
    day: int = 24,
    week: int = 168,
) -> dict[str, Block]:
    """All blocks bound to a panel's own column roles."""
    flags = [f"{c}{MISSING}" for c in spec.nullable]
    slow, quick, wide = (6, 12, 24, 48), (6, 12), (3, 6, 12, 24)

    def of(pattern: str, cols: Sequence[str], *sizes) -> list[str]:
        return [pattern.format(c=c, n=n) for c in cols for n in (sizes or ("",))]

    def both(prefix: str, cols: Sequence[str]) -> list[str]:
        return [n for c in cols for n in (f"{prefix}_sys_{c}", f"{prefix}_zone_{c}")]

    def cap(d):
        return capacity_weighted(d, spec, live)

    def ew(d):
        return backward_memory(d, spec, memory, slow)

    def ew2(d):
        return backward_memory(d, spec, asymmetric, quick)

    def cw(d):
        return centred_windows(d, spec, given, wide)

    def clim(d):
        return climatology(d, spec, cut)

    caps, windows = of("xs_cap_{c}", live), of("cw{n}_{c}", given, *wide)
    memories, memories2 = of("ew_{c}_{n}", memory, *slow), of("ew_{c}_{n}", asymmetric, *quick)
    shifts = {-day: f"lead{day}", day: f"lag{day}", week: f"lag{week}"}
    statics = ["level", "std", "cv", "iqr", "d1", f"d{week}", f"seas{week}", f"seas{day}", "util", "missrate"]
    made: dict[str, tuple[Sequence[str], Callable[[DataFrame], Built], bool]] = {
        "A1": (both("xs", given), lambda d: system_zone_means(d, spec, given), False),
        "A2": (both("xs2", [*live, *refill]), lambda d: system_zone_means_refilled(d, spec, [*live, *refill]), False),
        "A3": (of("xs_loo_{c}", live), lambda d: leave_one_out(d, spec, live), False),
        "A4": (of("xs_{n}_{c}", live, "share", "rank"), lambda d: shares_and_ranks(d, spec, live), False),
        "A5": (of("xs_{n}_{c}", live, "std", "rng"), lambda d: dispersion(d, spec, live), False),
        "A6": ([*of("xs_miss_{c}", flags[:5]), "xs_miss_any_frac"], lambda d: missingness(d, spec, flags, 5), False),
        "A7": (of("xs_roll{n}_{c}", live, *wide), lambda d: rolling_system(d, spec, live, wide), False),
        "A8": (of("xs_clu_{c}", live), lambda d: learned_partition(d, spec, live, cut), True),
        "A9": (caps, cap, False),
        "A10": ([f"xs_ytgt{day}", f"xs_ytgt{week}"], lambda d: lagged_system_target(d, spec, (day, week)), False),
        "A11": (of("xs_{n}_{c}", live, *shifts.values()), lambda d: system_leads_lags(d, spec, live, tuple(shifts)), False),
        "A12": (of("xs_pc{n}_{c}", live, 0, 1, 2), lambda d: principal_components(d, spec, live, cut), True),
        "A14": ([f"xs_st_{n}" for n in statics], lambda d: behaviour_statics(d, spec, cut, flags, day, week), True),
        "A15": (["xs_hier_sys", "xs_hier_drift", "xs_hier_zone"], lambda d: hierarchical_target(d, spec, week=week), False),
        "B1": (windows, cw, False),
        "B2": (of("cw{n}_{c}", spec.signals, 24), lambda d: centred_windows(d, spec, spec.signals, (24,)), False),
        "B3": ([*windows, *caps], compose(cw, cap), False),
        "C1": (["clim_how"], clim, True),
        "C2": (["clim_how", "clim_how_shape"], lambda d: climatology(d, spec, cut, shape=True), True),
        "C3": (["clim_how", *caps], compose(clim, cap), True),
        "EW": (memories, ew, False),
        "EW2": (memories2, ew2, False),
        "EWA9": ([*caps, *memories], compose(cap, ew), False),
        "EW2A9": ([*caps, *memories2], compose(cap, ew2), False),
    }
    if channel:
        made["A13"] = (["xs_sys_fc", "xs_zone_fc", "xs_rank_fc"], lambda d: channel_consensus(d, spec, channel), False)
    return {k: Block(tuple(names), build, fitted) for k, (names, build, fitted) in made.items()}


def rectangle_report(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row: series, timestamps, and timestamps that do not carry every series exactly once."""
    at = df.groupBy(spec.time).agg(F.count(F.lit(1)).alias("_n"))
    series = df.groupBy(spec.id).agg(F.count(F.lit(1)).alias("_m")).agg(F.count(F.lit(1)).alias("n_series"))
    n = series.first()["n_series"]
    return at.agg(
        F.lit(n).cast("long").alias("n_series"),
        F.count(F.lit(1)).alias("n_times"),
        F.sum((F.col("_n") != n).cast("long")).alias("ragged_times"),
    )


def attach_aggregates(df: DataFrame, spec: PanelSpec, wanted: Sequence[str], blocks: dict[str, Block]) -> DataFrame:
    """Build the columns a model declares, from the one unfitted block that produces them all.

    No-op when they are present. Refuses a panel that is not a complete rectangle, a set no block
    produces, and a result with missing values.
    """
    wanted = list(wanted)
    if not wanted or all(c in df.columns for c in wanted):
        return df
    shape = rectangle_report(df, spec).first()
    if shape["ragged_times"]:
        raise ValueError(f"not a complete {shape['n_series']}-series rectangle: {shape['ragged_times']} ragged timestamps")
    for name, block in blocks.items():
        if block.fitted or not set(wanted) <= set(block.names):
            continue
        built, names = block.build(df)
        holes = built.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in wanted)).first().asDict()
        if any(holes.values()):
            raise ValueError(f"block {name} produced missing values {holes}; aggregate after imputation")
        return built.drop(*(n for n in names if n not in wanted))
    raise ValueError(f"no rebuildable block produces {wanted}")


def own_region_weighted(
    df: DataFrame, spec: PanelSpec, cut: Column | int, price: str, flags: dict[int, str], region: str
) -> Built:
    """Volume-weighted means of the price and of the event flag of each series' own region.

    ``flags`` maps a region code to its flag column; weights are the train means of the target,
    at least 1e-6. Missing values drop out of numerator and denominator alike.
    """
    own = F.lit(None).cast("double")
    for code, column in flags.items():
        own = F.when(F.col(region) == code, F.col(column).cast("double")).otherwise(own)
    volume = df.filter(F.col(spec.index) < cut).groupBy(spec.id).agg(
        F.greatest(F.avg(spec.target), F.lit(1e-6)).alias("_w")
    )
    out = df.join(volume, spec.id).withColumn("_own", own)

    def weighted(c: str) -> Column:
        return ratio(F.sum(F.col(c) * F.col("_w")), F.sum(F.when(F.col(c).isNotNull(), F.col("_w"))))

    table = out.groupBy(spec.time).agg(weighted(price).alias("xs_price_cap"), weighted("_own").alias("xs_snap_cap"))
    return out.drop("_w", "_own").join(table, spec.time), ["xs_price_cap", "xs_snap_cap"]


def varying_columns(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> DataFrame:
    """One row per column: timestamps at which it differs across series, and whether it ever does."""
    at = df.groupBy(spec.time).agg(*((F.max(c) - F.min(c)).alias(c) for c in cols))
    row = at.agg(*(F.sum((F.coalesce(F.col(c), F.lit(0.0)) > 0).cast("long")).alias(c) for c in cols))
    return row.select(
        F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("n_varying")) for c in cols))).alias("_e")
    ).select("_e.col", "_e.n_varying", (F.col("_e.n_varying") > 0).alias("varies"))
