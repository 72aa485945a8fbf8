"""Where the error is: concentration, ranking stability, lead bands, residual structure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import metrics as M
from panelloom.functions import ordered, quantiles
from panelloom.functions.exprs import ratio
from panelloom.operators.aggregates import error_share, residual_corr
from panelloom.spec import PanelSpec


def error_concentration(df: DataFrame, spec: PanelSpec, member: str, tops: Sequence[int] = (10, 20)) -> DataFrame:
    """Share of error and volume held by the worst series, and the range of series WAPE.

    The worst series are found by a bounded top-n, not by sorting all series in one task.
    """
    units = error_share(df, spec, member)
    total = units.agg(
        F.sum("ae").alias("ae"), F.sum("ya").alias("ya"), F.count(F.lit(1)).alias("n_units"),
        F.min("unit_wape").alias("unit_wape_min"), F.max("unit_wape").alias("unit_wape_max"),
    )
    t = total.first()
    worst = units.orderBy(F.desc("ae"), spec.id).limit(max(tops))
    ranked = worst.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("ae"), spec.id)))
    shares = ranked.agg(
        *(
            x.alias(n)
            for k in tops
            for n, x in (
                (f"top{k}_share_of_error", F.sum(F.when(F.col("_r") <= k, F.col("ae"))) / F.lit(t["ae"])),
                (f"top{k}_share_of_volume", F.sum(F.when(F.col("_r") <= k, F.col("ya"))) / F.lit(t["ya"])),
            )
        )
    )
    uniform = min(1.0, tops[0] / t["n_units"])
    return shares.withColumns(
        {
            "n_units": F.lit(t["n_units"]).cast("long"),
            "unit_wape_min": F.lit(t["unit_wape_min"]),
            "unit_wape_max": F.lit(t["unit_wape_max"]),
            "over_uniform": F.col(f"top{tops[0]}_share_of_error") / F.lit(uniform),
        }
    )


def unit_error_map(df: DataFrame, spec: PanelSpec, member: str) -> DataFrame:
    """Per series: share of error, share of volume, WAPE and error per volume."""
    units = error_share(df, spec, member)
    t = units.agg(F.sum("ae").alias("ae"), F.sum("ya").alias("ya")).first()
    share_e, share_v = F.col("ae") / F.lit(t["ae"]), F.col("ya") / F.lit(t["ya"])
    return units.withColumns(
        {"share_of_error": share_e, "share_of_volume": share_v, "error_per_volume": ratio(share_e, share_v)}
    )


def kendall_tau(scores: DataFrame, by: str, item: str, score: str) -> DataFrame:
    """Kendall tau of the item ranking for every pair of groups: (a, b, tau).

    ``scores`` holds one number per (group, item): a report table of members and windows.
    """
    left = scores.select(F.col(by).alias("g"), F.col(item).alias("i"), F.col(score).alias("s"))
    order = left.alias("x").join(left.alias("z"), F.expr("x.g = z.g AND x.i < z.i")).select(
        F.col("x.g").alias("g"), F.col("x.i").alias("i"), F.col("z.i").alias("j"), F.sign(F.col("x.s") - F.col("z.s")).alias("d")
    )
    both = order.alias("x").join(order.alias("z"), F.expr("x.i = z.i AND x.j = z.j AND x.g < z.g"))
    return both.groupBy(F.col("x.g").alias("a"), F.col("z.g").alias("b")).agg(
        (F.sum(F.col("x.d") * F.col("z.d")) / F.count(F.lit(1))).alias("tau")
    )


def ranking_stability(df: DataFrame, spec: PanelSpec, members: Sequence[str]) -> DataFrame:
    """Tau between windows, and its mean in the row with NULL windows."""
    long = M.long_members(df, members, ["cutoff", spec.target])
    scores = long.groupBy("cutoff", "member").agg(M.wape(F.col(spec.target), F.col("yhat")).alias("wape"))
    tau = kendall_tau(scores, "cutoff", "member", "wape")
    return tau.groupingSets([["a", "b"], []], "a", "b").agg(F.avg("tau").alias("tau"))


def lead_bands(df: DataFrame, spec: PanelSpec, members: Sequence[str], width: int = 56) -> DataFrame:
    """WAPE per member and lead band of the scored block, with the member's rank in the band."""
    long = M.long_members(df, members, ["blk", spec.target])
    bands = long.groupBy(F.floor(F.col("blk") / width).alias("band"), "member").agg(
        M.wape(F.col(spec.target), F.col("yhat")).alias("wape")
    )
    w = Window.partitionBy("band").orderBy("wape", "member")
    return bands.withColumn("rank", F.row_number().over(w).cast("long"))


def band_stability(df: DataFrame, spec: PanelSpec, members: Sequence[str], width: int = 56) -> DataFrame:
    return kendall_tau(lead_bands(df, spec, members, width), "band", "member", "wape")


def statics_r2(df: DataFrame, spec: PanelSpec, member: str, statics: DataFrame, cols: Sequence[str]) -> DataFrame:
    """R2 and coefficients of log(series WAPE) on the statics."""
    units = error_share(df, spec, member).join(statics, spec.id).withColumn("label", F.log("unit_wape"))
    rows = VectorAssembler(inputCols=list(cols), outputCol="features").transform(units.filter("unit_wape > 0"))
    fit = LinearRegression(regParam=0.0, elasticNetParam=0.0, solver="normal").fit(rows)
    s = fit.summary
    values = [float(s.r2), float(fit.intercept), *map(float, fit.coefficients), int(s.numInstances)]
    schema = ", ".join(["r2 double", "intercept double", *(f"coef_{c} double" for c in cols), "n_units long"])
    return df.sparkSession.createDataFrame([tuple(values)], schema)


def member_spread(df: DataFrame, spec: PanelSpec, members: Sequence[str], blend: Column) -> DataFrame:
    """Row-wise disagreement of the members and how it relates to the blend's error."""
    cols = [F.col(m) for m in members]
    spread = F.greatest(*cols) - F.least(*cols)
    rows = df.select(spread.alias("spread"), F.abs(F.col(spec.target) - blend).alias("ae"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("spread").alias("mean_spread"), F.max("spread").alias("max_spread"),
        residual_corr(F.col("spread"), F.col("ae")).alias("corr_with_error"),
    )


def quintile_calibration(df: DataFrame, spec: PanelSpec, member: str, parts: int = 5) -> DataFrame:
    """Relative error of the totals by predicted-level bin; bins are cut at exact quantiles."""
    marks = quantiles.pooled_many(df, {f"q{i}": (member, i / parts) for i in range(1, parts)}).values()
    p, y = F.col(member), F.col(spec.target)
    bin_ = sum(((p > F.lit(m)).cast("int") for m in marks), F.lit(1))
    return df.groupBy(bin_.cast("long").alias("quintile")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(p).alias("mean_pred"), F.avg(y).alias("mean_y"),
        ratio(F.sum(p - y), F.sum(y)).alias("relative_error"),
    )


def dispersion_ratio(df: DataFrame, spec: PanelSpec, members: Sequence[str]) -> DataFrame:
    """Per member: within-series sd of the prediction over that of the target, root mean squares pooled."""
    y = F.col(spec.target)
    units = df.groupBy(spec.id).agg(
        F.var_pop(y).alias("_v"), F.count(F.lit(1)).alias("_n"), *(F.var_pop(m).alias(m) for m in members)
    )
    row = units.agg(
        *(F.sqrt(ratio(F.sum(F.col(m) * F.col("_n")), F.sum(F.col("_v") * F.col("_n")))).alias(m) for m in members)
    )
    parts = F.array(*(F.struct(F.lit(m).alias("member"), F.col(m).alias("sd_ratio")) for m in members))
    return row.select(F.explode(parts).alias("_p")).select("_p.*")


def lagged_correlation(df: DataFrame, spec: PanelSpec, signals: Sequence[str], lags: Sequence[int], target: str | None = None) -> DataFrame:
    """corr(signal at t-n, target at t) pooled over series, for each signal and lag."""
    y = F.col(target or spec.target)
    named = {f"_{s}_{n}": (F.col(s), n) for s in signals for n in lags}
    wide = ordered.lagged(df, spec, named).agg(*(residual_corr(F.col(k), y).alias(k) for k in named))
    parts = F.array(
        *(F.struct(F.lit(s).alias("signal"), F.lit(n).cast("long").alias("lag"), F.col(f"_{s}_{n}").alias("corr")) for s in signals for n in lags)
    )
    return wide.select(F.explode(parts).alias("_p")).select("_p.*")


def peak_lag(table: DataFrame) -> DataFrame:
    """Lag of the largest absolute correlation, the shortest on ties."""
    order = F.struct(F.round(F.abs("corr"), 12), -F.col("lag"))
    return table.filter(F.col("corr").isNotNull()).groupBy("signal").agg(
        F.max_by("lag", order).alias("peak_lag"), F.max_by("corr", order).alias("peak_corr")
    )


def missing_runs(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> DataFrame:
    """Length statistics of consecutive missing cells per column.

    Missing rows of one run share the last observed position before them, which identifies the run.
    """
    parts = None
    marked = ordered.carried(
        df, spec, {f"_l_{c}": F.when(F.col(c).isNotNull(), F.col(spec.index)) for c in cols}
    )
    for c in cols:
        runs = marked.filter(F.col(c).isNull()).groupBy(spec.id, F.coalesce(F.col(f"_l_{c}"), F.lit(-1)).alias("_r")).agg(
            F.count(F.lit(1)).alias("n")
        )
        # Run lengths are small integers, so their tally is short however many runs there are.
        tally = runs.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
        stats = tally.agg(
            F.sum("m").alias("runs"),
            (F.sum(F.col("n") * F.col("m")) / F.sum("m")).alias("mean_run"),
            F.percentile("n", F.lit(0.5), F.col("m")).alias("median_run"),
            F.percentile("n", F.lit(0.95), F.col("m")).alias("p95_run"),
            F.max("n").alias("max_run"),
        ).select(F.lit(c).alias("col"), "*")
        parts = stats if parts is None else parts.unionByName(stats)
    return parts


def pairwise_zone_correlation(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Mean correlation of series pairs within a zone and across zones, without forming pairs.

    With z-scored series, the squared sum over a group holds every pair's product once in each
    order plus the series' own, so group sums per timestamp give the sum over its pairs.
    """
    y = F.col(spec.target)
    stats = df.groupBy(spec.id).agg(
        F.avg(y).alias("_mu"), F.stddev_pop(y).alias("_sd"), F.count(F.lit(1)).alias("_t")
    ).filter("_sd > 0")
    z = df.join(stats, spec.id).withColumn("_z", (y - F.col("_mu")) / F.col("_sd"))
    zone = z.groupBy(spec.time, spec.zone).agg(F.sum("_z").alias("_s"), F.count(F.lit(1)).alias("_n"), F.max("_t").alias("_t"))
    at = zone.groupBy(spec.time).agg(F.sum("_s").alias("_all"), F.sum("_n").alias("_m"), F.max("_t").alias("_t"), F.sum(F.col("_s") * F.col("_s")).alias("_in"), F.sum(F.col("_n") * F.col("_n")).alias("_nn"))
    row = at.agg(
        F.sum(F.col("_in") / F.col("_t")).alias("_in"),
        F.sum(F.col("_all") * F.col("_all") / F.col("_t")).alias("_tot"),
        F.max("_m").alias("_m"),
        F.max("_nn").alias("_nn"),
    )
    within_pairs = (F.col("_nn") - F.col("_m")) / 2
    all_pairs = F.col("_m") * (F.col("_m") - 1) / 2
    within_sum, all_sum = (F.col("_in") - F.col("_m")) / 2, (F.col("_tot") - F.col("_m")) / 2
    return row.select(
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("same_zone"), within_pairs.cast("long").alias("pairs"), ratio(within_sum, within_pairs).alias("mean_corr")),
                F.struct(F.lit(False).alias("same_zone"), (all_pairs - within_pairs).cast("long").alias("pairs"), ratio(all_sum - within_sum, all_pairs - within_pairs).alias("mean_corr")),
            )
        ).alias("_p")
    ).select("_p.*")


def residual_checklist(df: DataFrame, spec: PanelSpec, member: str, lags: Sequence[int], covariates: Sequence[str], band: int) -> DataFrame:
    """Residual median per lead band, autocorrelation, spread against level, relation to covariates.

    Long form: (check, key, value).
    """
    block = [spec.id, "cutoff"]
    rows = df.withColumn("_e", F.col(spec.target) - F.col(member))
    bands = quantiles.grouped(
        rows.withColumn("_band", F.floor(F.col("blk") / band)), ["_band"], {"value": ("_e", 0.5)}, bounded=False, few_keys=True
    ).select(F.lit("median_by_band").alias("check"), F.col("_band").cast("string").alias("key"), "value")
    inner = spec.with_(series_len=spec.full_horizon)
    e = ordered.lagged(rows.withColumn(spec.index, F.col("step")), inner, {f"_l{n}": (F.col("_e"), n) for n in lags}, keys=block)
    acf = e.agg(*(residual_corr(F.col("_e"), F.col(f"_l{n}")).alias(str(n)) for n in lags))
    rel = rows.agg(
        residual_corr(F.abs("_e"), F.col(member)).alias("spread_vs_level"),
        *(residual_corr(F.col("_e"), F.col(c)).alias(f"corr_{c}") for c in covariates),
    )

    def flat(row: DataFrame, check: str, names: dict[str, str]) -> DataFrame:
        parts = F.array(*(F.struct(F.lit(check if k else n).alias("check"), F.lit(k).alias("key"), F.col(f"`{n}`").alias("value")) for n, k in names.items()))
        return row.select(F.explode(parts).alias("_p")).select("_p.*")

    out = bands.unionByName(flat(acf, "acf", {str(n): str(n) for n in lags}))
    out = out.unionByName(flat(rel.select("spread_vs_level"), "spread_vs_level", {"spread_vs_level": "all"}))
    if covariates:
        out = out.unionByName(flat(rel, "corr_covariate", {f"corr_{c}": c for c in covariates}))
    return out


def unit_residual_medians(df: DataFrame, spec: PanelSpec, member: str) -> DataFrame:
    rows = df.withColumn("_e", F.col(spec.target) - F.col(member))
    return quantiles.grouped(rows, [spec.id], {"median_residual": ("_e", 0.5)}, bounded=spec.bounded)


def forecast_smell(df: DataFrame, spec: PanelSpec, channels: Sequence[str]) -> DataFrame:
    """Share of missing cells and correlation with the target per stored forecast channel."""
    y = F.col(spec.target)
    row = df.agg(
        *(F.avg(F.col(c).isNull().cast("double")).alias(f"_m_{c}") for c in channels),
        *(residual_corr(F.when(y.isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), y)).alias(f"_c_{c}") for c in channels),
    )
    parts = F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"_m_{c}").alias("missing_share"), F.col(f"_c_{c}").alias("corr")) for c in channels))
    return row.select(F.explode(parts).alias("_p")).select("_p.*")

