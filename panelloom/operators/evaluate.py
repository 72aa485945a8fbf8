"""Scoring, uncertainty and admission of forecasts held in a prediction cube."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import metrics as M
from panelloom.functions import digests, ordered
from panelloom.functions.exprs import ratio
from panelloom.operators.aggregates import residual_corr
from panelloom.operators.index import select_regime
from panelloom.session import checkpointed
from panelloom.spec import PanelSpec

# Fixed values of the admission rules.
ERR_CORR_THRESHOLD = 0.95
MIN_WINDOW_FRACTION = 2 / 3
N_BOOTSTRAP = 4_000
CLEAN_LIFT = 0.083
MIN_REFIT_WEIGHT = 0.05


# ---------------------------------------------------------------- error reports


def pooled_wape(df: DataFrame, spec: PanelSpec, members: Sequence[str], regime: str) -> DataFrame:
    """Per member: one row per window and one pooled row (cutoff NULL), sums divided once."""
    rows = select_regime(df, spec, regime)
    long = M.long_members(rows, members, ["cutoff", spec.target])
    y, p = F.col(spec.target), F.col("yhat")
    sums = long.groupBy("member", "cutoff").agg(
        M.abs_error(y, p).alias("ae"), F.sum(F.abs(y)).alias("ya"), F.count(F.lit(1)).alias("n_rows")
    )
    return sums.groupingSets([["member", "cutoff"], ["member"]], "member", "cutoff").agg(
        F.sum("ae").alias("ae"), F.sum("ya").alias("ya"), F.sum("n_rows").alias("n_rows")
    ).withColumn("wape", ratio(F.col("ae"), F.col("ya")))


def metric_report(df: DataFrame, spec: PanelSpec, members: Sequence[str]) -> DataFrame:
    """Six metrics for near, far and all steps, per window and pooled, in one pass of grouping sets."""
    long = M.long_members(df, members, ["cutoff", "step", spec.target])
    long = long.withColumn("half", F.when(F.col("step") <= spec.score_len, "near").otherwise("far"))
    sets = [["member", "half", "cutoff"], ["member", "half"], ["member", "cutoff"], ["member"]]
    six = M.six(F.col(spec.target), F.col("yhat"))
    out = long.groupingSets(sets, "member", "half", "cutoff").agg(F.count(F.lit(1)).alias("n_rows"), *M.named(six))
    return out.withColumn("horizon", F.coalesce("half", F.lit("all"))).drop("half")


def panel_metrics(df: DataFrame, spec: PanelSpec, members: Sequence[str]) -> DataFrame:
    long = M.long_members(df, members, [spec.target])
    return long.groupBy("member").agg(*M.named(M.zero_aware(F.col(spec.target), F.col("yhat"))))


def window_sigma(report: DataFrame) -> DataFrame:
    """Population deviation of the window scores per member; one window gives 0."""
    return report.filter(F.col("cutoff").isNotNull()).groupBy("member").agg(
        F.when(F.count("wape") > 1, F.stddev_pop("wape")).otherwise(F.lit(0.0)).alias("sigma")
    )


def skill_table(report: DataFrame, baseline: str = "seasonal_naive") -> DataFrame:
    """1 - wape / wape(baseline) from the pooled rows."""
    pooled = report.filter(F.col("cutoff").isNull()).select("member", "wape")
    base = pooled.filter(F.col("member") == baseline).first()
    if base is None or not base["wape"]:
        raise ValueError(f"baseline {baseline!r} has no usable WAPE")
    return pooled.withColumn("skill", 1 - F.col("wape") / F.lit(base["wape"]))


def contamination_check(report: DataFrame, plain: str, cascade: str) -> DataFrame:
    """Lift of the cascade over the plain member; twice the clean lift is suspicious."""
    pooled = report.filter(F.col("cutoff").isNull())

    def of(m: str) -> Column:
        return F.max(F.when(F.col("member") == m, F.col("wape")))

    row = pooled.agg(of(plain).alias("plain_wape"), of(cascade).alias("cascade_wape"))
    lift = ratio(F.col("plain_wape") - F.col("cascade_wape"), F.col("plain_wape"))
    verdict = F.when(lift.isNull(), "not evaluable").when(lift > 2 * CLEAN_LIFT, "suspicious").otherwise("consistent")
    return row.withColumn("lift", lift).withColumn("verdict", verdict)


def overfit_gap(cv: DataFrame, insample: DataFrame) -> DataFrame:
    """Mean window WAPE minus in-sample WAPE per member."""
    folds = cv.filter(F.col("cutoff").isNotNull()).groupBy("member").agg(F.avg("wape").alias("cv_wape"))
    fit = insample.filter(F.col("cutoff").isNull()).select("member", F.col("wape").alias("train_wape"))
    return folds.join(fit, "member").withColumn("gap", F.col("cv_wape") - F.col("train_wape"))


def score_offset(scores: DataFrame) -> DataFrame:
    """External score minus 100 x cross-validated one per revision, and its change."""
    w = Window.partitionBy("member").orderBy("revision")
    out = scores.withColumn("offset", F.col("external") - 100 * F.col("cv"))
    return out.withColumns(
        {"offset_change": F.col("offset") - F.lag("offset").over(w), "external_change": F.col("external") - F.lag("external").over(w)}
    )


def rolling_cv(df: DataFrame, spec: PanelSpec, members: Sequence[str]) -> DataFrame:
    """Mean and deviation over folds beside the pooled six metrics."""
    long = M.long_members(df, members, ["cutoff", spec.target])
    y, p = F.col(spec.target), F.col("yhat")
    folds = long.groupBy("member", "cutoff").agg(M.wape(y, p).alias("w"))
    spread = folds.groupBy("member").agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("w").alias("cv_wape_mean"), F.stddev_pop("w").alias("cv_wape_std")
    )
    return spread.join(long.groupBy("member").agg(*M.named(M.six(y, p))), "member")


# ---------------------------------------------------------------- validation


def validation_report(df: DataFrame, spec: PanelSpec, member: str) -> DataFrame:
    """One row of counts: rows, missing cells, duplicate keys, ragged series."""
    keys = [c for c in ("cutoff", spec.id, spec.time) if c in df.columns]
    blocks = [c for c in ("cutoff", spec.id) if c in df.columns]
    cells = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col(spec.target).isNull().cast("long")).alias("_y"),
        F.sum((F.col(member).isNull() | F.isnan(member)).cast("long")).alias("_p"),
    )
    sizes = cells.groupBy(*blocks).agg(
        F.sum("_n").alias("_rows"), F.sum("_y").alias("_y"), F.sum("_p").alias("_p"), F.sum(F.col("_n") - 1).alias("_dup")
    )
    return sizes.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("_y"), F.lit(0)).alias("null_target"),
        F.coalesce(F.sum("_p"), F.lit(0)).alias("null_member"),
        F.coalesce(F.sum("_dup"), F.lit(0)).alias("duplicates"),
        F.min("_rows").alias("min_rows"),
        F.max("_rows").alias("max_rows"),
    )


def validate_prediction(df: DataFrame, spec: PanelSpec, member: str) -> DataFrame:
    """Return ``df`` unchanged, or raise with the counts that are wrong."""
    missing = [c for c in (spec.id, spec.time, "cutoff", spec.target, member) if c not in df.columns]
    if missing:
        raise ValueError(f"{member}: missing columns {missing}")
    row = validation_report(df, spec, member).first()
    if not row["n_rows"]:
        raise ValueError(f"{member}: empty prediction frame")
    wrong = {k: row[k] for k in ("null_target", "null_member", "duplicates") if row[k]}
    if row["min_rows"] != row["max_rows"]:
        wrong["rows per series"] = (row["min_rows"], row["max_rows"])
    if wrong:
        raise ValueError(f"{member}: {wrong}")
    return df


def duplicate_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("_n") - 1).alias("duplicates")
    )


def output_contract(output: DataFrame, index: DataFrame, keys: Sequence[str], pred: str) -> DataFrame:
    """One row of counts comparing an output with the index it must answer; all zero is a pass."""
    side = output.groupBy(*keys).agg(F.count(F.lit(1)).alias("_o"), F.max(pred).alias("_p"), F.min(pred).alias("_q"))
    want = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("_i"))
    both = side.join(want, list(keys), "full_outer")

    def n(cond: Column) -> Column:
        return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))

    infinite = F.col("_p").isNull() | F.isnan("_p") | (F.col("_p") == float("inf")) | (F.col("_q") == float("-inf"))
    return both.agg(
        n(F.col("_o").isNull()).alias("missing"),
        n(F.col("_i").isNull()).alias("extra"),
        F.coalesce(F.sum(F.col("_o") - 1), F.lit(0)).alias("duplicates"),
        n(F.col("_o").isNotNull() & infinite).alias("non_finite"),
        n(F.col("_q") < 0).alias("negative"),
    )


# ---------------------------------------------------------------- comparisons


def error_correlation(df: DataFrame, spec: PanelSpec, members: Sequence[str]) -> DataFrame:
    """Residual correlation for every pair of members, from one aggregation."""
    pairs = list(combinations(members, 2))
    y = F.col(spec.target)
    row = df.agg(*(residual_corr(F.col(a) - y, F.col(b) - y).alias(f"{a}|{b}") for a, b in pairs))
    parts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs))
    return row.select(F.explode(parts).alias("_p")).select("_p.*")


def min_windows_required(n: int) -> int:
    return max(1, math.ceil(MIN_WINDOW_FRACTION * n))


def windows_won(df: DataFrame, spec: PanelSpec, candidate: str, baseline: str) -> DataFrame:
    """Per-window WAPE of both arms and the margin, positive when the candidate is better."""
    y = F.col(spec.target)
    return (
        df.groupBy("cutoff")
        .agg(M.wape(y, F.col(candidate)).alias("candidate"), M.wape(y, F.col(baseline)).alias("baseline"))
        .withColumn("delta", F.col("baseline") - F.col("candidate"))
        .withColumn("won", F.col("delta") > 0)
    )


def block_errors(df: DataFrame, spec: PanelSpec, arms: dict[str, str]) -> DataFrame:
    """Error sums per (cutoff, series): all a resample of whole blocks needs."""
    y = F.col(spec.target)
    return df.groupBy("cutoff", spec.id).agg(
        F.sum(F.abs(y)).alias("ya"), *(M.abs_error(y, F.col(m)).alias(n) for n, m in arms.items())
    )


# Blocks sent to the tasks at a time, 24 bytes each, and draws made at a time inside a task.
SLAB, AT_ONCE = 1 << 21, 1 << 16
ARMS = ("ae_c", "ae_b", "ya")


def draw(seed: int, rep: Column, slot: Column, n: int) -> Column:
    """Block number drawn for a slot of a replicate: 32 bits of a digest, modulo the block count. Tasks draw the same by ``digests.drawn``."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), slot.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(n))


def bootstrap_draws(df: DataFrame, spec: PanelSpec, candidate: str, baseline: str, *, n_boot: int = N_BOOTSTRAP, seed: int = 0) -> DataFrame:
    """Pooled WAPE difference per replicate: (rep, delta).

    Whole (cutoff, series) blocks are drawn with replacement, the same draw for both arms. Blocks
    are aggregated before drawing. Draws are numbered by range, so no task holds a hot share of
    them, and are summed per replicate inside the tasks, whatever the count of blocks.
    """
    blocks = block_errors(df, spec, {candidate: candidate, baseline: baseline})
    return _replicates(blocks, spec, candidate, baseline, n_boot, seed)


def _replicates(blocks: DataFrame, spec: PanelSpec, candidate: str, baseline: str, n_boot: int, seed: int, slab: int = SLAB) -> DataFrame:
    """The drawn sums, slab by slab of the numbered blocks: each task makes its draws, looks them up in the slab's packed sums
    and adds them up per replicate, so that drawn rows are neither shuffled nor handed over and no more than a slab is sent."""
    spark = blocks.sparkSession
    table = ordered.global_index(blocks, ["cutoff", spec.id], "pos")
    table = checkpointed(table.select("pos", *(F.col(c).cast("double").alias(a) for c, a in zip((candidate, baseline, "ya"), ARMS))))
    n = table.count()
    runs = -(-n_boot * n // AT_ONCE)
    slots = spark.range(0, runs, 1, max(1, min(runs, max(spark.sparkContext.defaultParallelism, n_boot * n // 2_000_000))))
    parts = None
    for lo in range(0, max(n, 1), slab):
        part, packed = _slab_sums(table, slots, lo, min(slab, n - lo), n, n_boot, seed)
        if lo + slab < n:  # the last one is read with the result
            part = checkpointed(part)  # a row per replicate
            packed.destroy()
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.groupBy("rep").agg(*(F.sum(a).alias(a) for a in ARMS))
    return sums.select("rep", (ratio(F.col("ae_b"), F.col("ya")) - ratio(F.col("ae_c"), F.col("ya"))).alias("delta"))


def _slab_sums(table: DataFrame, slots: DataFrame, lo: int, size: int, n: int, n_boot: int, seed: int) -> tuple[DataFrame, Broadcast]:
    """Sums of the draws that fall on ``size`` blocks from ``lo`` on, per replicate, null where no drawn block has a value; and
    the broadcast they are looked up in. Draws are numbered through all replicates, ``AT_ONCE`` to a row of ``slots``."""
    spark = table.sparkSession
    got = table.filter(F.col("pos").between(lo, lo + size - 1)).toArrow()
    at = got.column("pos").to_numpy() - lo
    values, known = np.zeros((len(ARMS), size)), np.zeros((len(ARMS), size), bool)
    for i, arm in enumerate(ARMS):
        known[i, at] = got.column(arm).is_valid().to_numpy()
        values[i, at] = pc.fill_null(got.column(arm), 0.0).to_numpy()
    packed = spark.sparkContext.broadcast((values, known))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, known = packed.value
        whole = known.all(axis=1)
        sums, seen, hit = np.zeros((len(ARMS), n_boot)), np.zeros((len(ARMS), n_boot), np.int64), np.zeros(n_boot, np.int64)
        for first in (int(x) * AT_ONCE for batch in batches for x in batch.column("id").to_numpy()):
            rep, slot = np.divmod(np.arange(first, min(first + AT_ONCE, n_boot * n)), n)
            at = digests.drawn(seed, rep, slot, n) - lo
            if size < n:
                mine = (at >= 0) & (at < size)
                rep, at = rep[mine], at[mine]
            if len(rep):
                low = rep[0]
                m = rep[-1] - low + 1
                reach = slice(low, low + m)
                times = np.bincount(rep - low, minlength=m)
                hit[reach] += times
                for i in range(len(ARMS)):
                    sums[i, reach] += np.bincount(rep - low, values[i].take(at), m)
                    seen[i, reach] += times if whole[i] else np.bincount(rep - low, known[i].take(at), m).astype(np.int64)
        reps = np.flatnonzero(hit)
        yield pa.RecordBatch.from_arrays([pa.array(reps), *(pa.array(s[reps], mask=k[reps] == 0) for s, k in zip(sums, seen))], names=["rep", *ARMS])

    arms = ", ".join(f"{a} double" for a in ARMS)
    part = slots.mapInArrow(each, f"rep long, {arms}").groupBy("rep").agg(*(F.sum(a).alias(a) for a in ARMS))
    return part, packed


def paired_bootstrap(df: DataFrame, spec: PanelSpec, candidate: str, baseline: str, *, n_boot: int = N_BOOTSTRAP, seed: int = 0) -> DataFrame:
    """One row: observed delta, its bootstrap deviation, 95 % interval and delta in deviations."""
    blocks = checkpointed(block_errors(df, spec, {candidate: candidate, baseline: baseline}))
    seen = blocks.agg(
        (ratio(F.sum(baseline), F.sum("ya")) - ratio(F.sum(candidate), F.sum("ya"))).alias("delta"), F.count(F.lit(1)).alias("n")
    ).first()
    n, seen = seen["n"], seen["delta"]
    draws = _replicates(blocks, spec, candidate, baseline, n_boot, seed)
    row = draws.agg(
        F.stddev_samp("delta").alias("se"),
        F.percentile("delta", F.lit(0.025)).alias("ci_low"),
        F.percentile("delta", F.lit(0.975)).alias("ci_high"),
    )
    return row.select(
        F.lit(candidate).alias("candidate"), F.lit(baseline).alias("baseline"), F.lit(seen).alias("delta"),
        "se", "ci_low", "ci_high", ratio(F.lit(seen), F.col("se")).alias("delta_in_se"),
        F.lit(n).cast("long").alias("n_blocks"), F.lit(n_boot).cast("long").alias("n_boot"),
    )


def evaluate_admission(
    df: DataFrame, spec: PanelSpec, candidate: str, baseline: str, regime: str, *,
    incumbents: Sequence[str] = (), threshold: float = ERR_CORR_THRESHOLD,
) -> DataFrame:
    """The three advisory checks as one row; nothing is dropped."""
    rows = select_regime(df, spec, regime)
    y = F.col(spec.target)
    others = [m for m in incumbents if m != candidate]
    sums = rows.groupBy("cutoff").agg(
        M.abs_error(y, F.col(candidate)).alias("c"), M.abs_error(y, F.col(baseline)).alias("b"), F.sum(F.abs(y)).alias("a")
    ).withColumn("delta", ratio(F.col("b") - F.col("c"), F.col("a")))
    report = sums.agg(
        ratio(F.sum("c"), F.sum("a")).alias("candidate_wape"),
        ratio(F.sum("b"), F.sum("a")).alias("baseline_wape"),
        F.count(F.lit(1)).alias("windows_total"),
        F.sum((F.col("delta") > 0).cast("long")).alias("windows_won"),
        F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("delta_spread"),
        F.stddev_pop(ratio(F.col("b"), F.col("a"))).alias("baseline_sigma"),
    )
    need = F.greatest(F.lit(1), F.ceil(F.col("windows_total") * F.lit(MIN_WINDOW_FRACTION) - F.lit(1e-9)))
    report = report.withColumns(
        {
            "margin": F.col("baseline_wape") - F.col("candidate_wape"),
            "windows_required": need.cast("long"),
        }
    )
    if others:
        corr = rows.agg(*(residual_corr(F.col(candidate) - y, F.col(m) - y).alias(m) for m in others)).first()
        known = [corr[m] for m in others if corr[m] is not None]
        worst = max(known) if known else None
        report = report.withColumn("max_err_corr", F.lit(worst).cast("double"))
        orthogonal = F.lit(all(c < threshold for c in known))
    else:
        report = report.withColumn("max_err_corr", F.lit(None).cast("double"))
        orthogonal = F.lit(None).cast("boolean")
    return report.withColumns(
        {
            "pooled_improves": F.col("margin") > 0,
            "majority_improves": F.col("windows_won") >= F.col("windows_required"),
            "orthogonal": orthogonal,
        }
    )


def final_bar(bootstrap: DataFrame, wins: DataFrame, refit_weight: float, variants_searched: int | None) -> DataFrame:
    """Interval excludes zero, every window won, refit weight large enough, search size declared."""
    won = wins.agg(F.every("won").alias("all_windows"))
    row, w = bootstrap.first(), won.first()
    return bootstrap.select("candidate", "baseline", "delta", "ci_low", "ci_high").withColumns(
        {
            "ci_excludes_zero": F.lit(row["delta"] > 0 and row["ci_low"] > 0),
            "all_windows_won": F.lit(bool(w["all_windows"])),
            "refit_weight_ok": F.lit(refit_weight >= MIN_REFIT_WEIGHT),
            "search_declared": F.lit(variants_searched is not None),
        }
    ).withColumn(
        "admitted",
        F.col("ci_excludes_zero") & F.col("all_windows_won") & F.col("refit_weight_ok") & F.col("search_declared"),
    )


def folds(df: DataFrame, spec: PanelSpec, cutoffs: Sequence[int], embargo: int | None = None) -> DataFrame:
    """Every row in each instrument it takes part in: (instrument, fold, role = fit | score).

    * ``standing``: early rows of each block fit, late rows are scored;
    * ``leave_one_out``: the other windows fit, one window is scored;
    * ``forward``: windows whose block ended an embargo before the scored block begins fit it.
    """
    gap = spec.score_len if embargo is None else embargo
    blk, cut = F.col("blk"), F.col("cutoff")

    def tag(instrument: str, fold, role: Column) -> Column:
        return F.struct(F.lit(instrument).alias("instrument"), F.lit(fold).cast("long").alias("fold"), role.alias("role"))

    tags = [tag("standing", 0, F.when(blk < spec.late_from, "fit").otherwise("score"))]
    for c in sorted(cutoffs):
        tags.append(tag("leave_one_out", c, F.when(cut == c, "score").otherwise("fit")))
        # The scored block starts one scored length after the cutoff; the fitted block ends two after its own.
        past = cut + spec.full_horizon + gap <= F.lit(c + spec.score_len)
        tags.append(tag("forward", c, F.when(cut == c, "score").when(past, "fit")))
    out = df.withColumn("_t", F.explode(F.filter(F.array(*tags), lambda t: t["role"].isNotNull())))
    return out.select(*df.columns, "_t.instrument", "_t.fold", "_t.role")
