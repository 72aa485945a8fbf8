"""The batch runs a user starts: graded inference, one panel end to end, a blend sweep."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions import metrics as M
from panelloom.operators import baselines, blend, blocks, evaluate, impute, index, members
from panelloom.operators.assembly import join_members
from panelloom.operators.members import TreeConfig
from panelloom.session import checkpointed
from panelloom.sources.panel_files import assign_predictions
from panelloom.spec import PanelSpec


def predict(
    history: DataFrame,
    covariates: DataFrame,
    forecast_index: DataFrame,
    spec: PanelSpec,
    runners: Mapping[str, Callable[[DataFrame, int, int], DataFrame]],
    rungs: Sequence[tuple[str, Mapping[str, float]]],
    *,
    aggregates: Sequence[str] = (),
    block_registry: Callable[[PanelSpec], dict[str, blocks.Block]] | None = None,
    gamma: float = blend.DESMOOTH_GAMMA,
) -> tuple[DataFrame, str]:
    """History and covariates to predictions for exactly the requested rows, in their order.

    The gap and the horizon are read off the two inputs. A member that fails is left out and the
    best rung whose members all ran is used; the name of the rung is returned.
    """
    keys = [spec.id, spec.time]
    plan = impute.horizon_plan(history, forecast_index, spec).first()
    h = plan["h_required"]
    hist = history if spec.index in history.columns else index.add_index(history, spec)
    cut = index.common_length(hist, spec)
    stats = impute.fit_fill_stats(hist, spec)
    grid = impute.future_grid(hist, spec, h)
    future = impute.build_future(covariates, grid, spec, stats)
    statics = hist.groupBy(spec.id).agg(*(F.max(c).alias(c) for c in spec.statics))
    future = future.join(grid, keys).withColumn(spec.index, F.lit(cut) + F.col("step") - 1).join(statics, spec.id)
    base = [*keys, spec.index, spec.target, *spec.signals, *spec.statics]
    whole = impute.apply_fill(hist, spec, stats, add_flags=False).select(*base).unionByName(
        future.withColumn(spec.target, F.lit(None).cast("double")).select(*base)
    )
    if aggregates:
        # On history and horizon joined: a memory restarted at the boundary would be silently wrong.
        whole = blocks.attach_aggregates(whole, spec, aggregates, block_registry(spec))
    whole = checkpointed(whole)
    done: dict[str, DataFrame] = {}
    for name, run in runners.items():
        try:
            done[name] = checkpointed(run(whole, cut, h).select(*keys, name))
        except Exception as e:  # noqa: BLE001 - a failed member must not lose the run
            print(f"member {name} left out: {type(e).__name__}: {e}")
    rung, weights = blend.choose_rung(list(done), rungs)
    cube = join_members({m: done[m] for m in weights}, keys)
    out = cube.select(*keys, blend.convex(weights).alias("prediction"))
    asked = out.join(forecast_index.select(*keys).dropDuplicates(), keys, "left_semi")
    smooth = blend.desmooth(asked, [spec.id], "prediction", gamma)
    final = index.guard_predictions(smooth, "prediction")
    return assign_predictions(forecast_index, final, keys, "prediction"), rung


ARMS = ("naive", "seasonal_naive", "seasonal_mean", "channel", "tree", "recursive")


def run_panel(
    df: DataFrame, spec: PanelSpec, config: TreeConfig, arms: Sequence[str] = ARMS, *, tree_weight: float = 0.24, partner: str = "channel"
) -> DataFrame:
    """All arms on one equal-length panel: one row per arm with status, metrics, skill and seconds.

    The horizon is gap + score; a blend weight is fitted on the gap half and judged on the scored
    one. An arm that fails is a row with its error.
    """
    from panelloom.operators import origin

    length = index.common_length(df, spec)
    cut, h = length - spec.full_horizon, spec.full_horizon
    rows = index.horizons(df.select(spec.id, spec.time, spec.index), spec, [cut])
    keys = [spec.id, spec.time]
    runners: dict[str, Callable[[], DataFrame]] = {
        "naive": lambda: baselines.last_value(rows, df, spec, cutoffs=[cut]),
        "seasonal_naive": lambda: baselines.seasonal_naive(rows, df, spec, cutoffs=[cut]),
        "seasonal_mean": lambda: baselines.seasonal_mean(rows, df, spec, [cut]),
        # The zero-shot channel is one horizon block of a block forecaster, clipped at zero.
        "channel": lambda: origin.forecast_horizon(df, spec, cut, h, "seasonal_mean", "channel")[0],
        "tree": lambda: members.forecast_gapped(df, spec, members.fit_gapped(df, spec, cut, config)),
        "recursive": lambda: members.recursive_trees(df, spec, cut, h, config),
    }
    labels = df.filter(F.col(spec.index) >= cut).select(
        *keys, spec.target, (F.col(spec.index) >= cut + spec.score_len).alias("is_scored")
    )
    y, out, frames = F.col(spec.target), [], {}

    def record(arm: str, frame: DataFrame, column: str, seconds: float, weight: float | None = None) -> None:
        row = frame.filter("is_scored").agg(*M.named(M.zero_aware(y, F.col(column)))).first()
        out.append((arm, "ok", None, weight, seconds, *(row[m] for m in METRICS)))

    for arm in arms:
        start = time.perf_counter()
        if arm not in runners:
            out.append((arm, "unknown arm", None, None, 0.0, *([None] * len(METRICS))))
            continue
        try:
            frame = checkpointed(labels.join(runners[arm]().select(*keys, arm), keys))
            frames[arm] = frame
            record(arm, frame, arm, time.perf_counter() - start)
        except Exception as e:  # noqa: BLE001 - recorded, not fatal
            out.append((arm, "error", f"{type(e).__name__}: {e}", None, time.perf_counter() - start, *([None] * len(METRICS))))
    if "tree" in frames and partner in frames:
        both = join_members({m: frames[m] for m in ("tree", partner)}, [*keys, spec.target, "is_scored"])
        fitted = blend.gap_refit(both, spec, "tree", partner).first()["weight"]
        for arm, w in (("blend", tree_weight), ("blend_refit", fitted)):
            mixed = both.withColumn(arm, F.greatest(F.lit(0.0), blend.pair("tree", partner)(w)))
            record(arm, mixed, arm, 0.0, w)
    fields = ", ".join(f"{m} double" for m in METRICS)
    table = df.sparkSession.createDataFrame(out, f"arm string, status string, error string, weight double, seconds double, {fields}")
    base = table.filter("arm = 'seasonal_naive' AND status = 'ok'").first()
    skill = 1 - F.col("wape") / F.lit(base["wape"]) if base and base["wape"] else F.lit(None).cast("double")
    return table.withColumn("skill", skill)


METRICS = ("wape", "mae", "mse", "rmse", "mape", "smape", "zero_frac", "mape_nonzero", "smape_zero_share")


def sweep(cube: DataFrame, spec: PanelSpec, cols: Sequence[str], incumbent: Mapping[str, float], *, max_size: int = 3, n_boot: int = evaluate.N_BOOTSTRAP) -> dict[str, DataFrame]:
    """Blend search over a member cube: solo scores, whole-pool simplex, combinations, and the test
    of the best against the incumbent. The cube is written once and read by every step."""
    rows = checkpointed(cube)
    early, late = rows.filter(F.col("blk") < spec.late_from), rows.filter(F.col("blk") >= spec.late_from)
    best = blend.search_simplex(rows, spec, cols, range(2, max_size + 1))
    top = best.orderBy("late_wape", "members").first()
    weights = dict(zip(top["members"].split("+"), top["weights"]))
    tested = late.withColumns({"_c": blend.weighted_sum(weights), "_i": blend.convex(incumbent)})
    pool = blend.fit_simplex(early, spec, cols)
    return {
        "solo": evaluate.pooled_wape(late, spec, cols, "full"),
        "pool": late.agg(M.wape(F.col(spec.target), blend.weighted_sum(pool)).alias("late_wape")).withColumn(
            "weights", F.array(*(F.lit(float(pool[c])) for c in cols))
        ),
        "combinations": best,
        "error_correlation": evaluate.error_correlation(late, spec, cols),
        "best_vs_incumbent": evaluate.paired_bootstrap(tested, spec, "_c", "_i", n_boot=n_boot),
    }
