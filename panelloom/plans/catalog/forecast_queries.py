"""Rolling-origin design, baselines, forecast blocks and error metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelloom.functions import metrics as M
from panelloom.operators import aggregates, baselines, design, evaluate, index, members, origin
from panelloom.plans.registry import query
from panelloom.plans.tables import CUTOFFS, MEMBERS, Tables

CUT, H, STRIDE = 331, 26, 13

PAIRS = (
    "pairs AS (SELECT unique_id, CAST(330 - 13 * j AS BIGINT) AS o, CAST(k AS BIGINT) AS k FROM (SELECT DISTINCT unique_id FROM panel_s)"
    " CROSS JOIN range(0, 26) a(j) CROSS JOIN range(1, 27) b(k) WHERE 330 - 13 * j > 0 AND k <= 13 * j)"
)


@query("D1_training_pairs", "panel_s", f"WITH {PAIRS} SELECT * FROM pairs")
def training_pairs(t: Tables):
    return design.training_pairs(t.panel_s, t.weekly, CUT, H, STRIDE)


@query("D2_inference_pairs", "panel_s", "SELECT unique_id, CAST(330 AS BIGINT) AS o, CAST(k AS BIGINT) AS k FROM (SELECT DISTINCT unique_id FROM panel_s), range(1, 27) r(k)")
def inference_pairs(t: Tables):
    return design.inference_pairs(t.panel_s, t.weekly, CUT, H)


@query(
    "D3_early_stopping_pairs", "panel_s",
    "WITH i AS (SELECT DISTINCT unique_id FROM panel_s)"
    " SELECT 'train' AS part, unique_id, CAST(317 - 13 * j AS BIGINT) AS o, CAST(k AS BIGINT) AS k FROM i, range(0, 25) a(j), range(1, 27) b(k)"
    " WHERE 317 - 13 * j > 0 AND k <= 13 * j UNION ALL"
    " SELECT 'valid', unique_id, 304, CAST(k AS BIGINT) FROM i, range(14, 27) r(k)",
)
def early_stopping(t: Tables):
    train, valid = design.early_stopping_pairs(t.panel_s, t.weekly, CUT, H, 13, STRIDE)
    return train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))


LAGS = (1, 2, 4, 13, 26)
ORIGIN_JOINS = " ".join(f"LEFT JOIN panel_s l{n} ON l{n}.unique_id = p.unique_id AND l{n}.hidx = p.o - {n - 1}" for n in LAGS)
ORIGIN_COLS = ", ".join(f"l{n}.y AS lag_{n}" for n in LAGS)
ROLLS = ", ".join(
    f"(SELECT avg(h.y) FROM panel_s h WHERE h.unique_id = p.unique_id AND h.hidx BETWEEN p.o - {n - 1} AND p.o) AS roll_{n}" for n in (4, 13)
)


@query(
    "D4_origin_lags", "panel_s",
    f"WITH {PAIRS} SELECT p.unique_id, p.o, p.k, {ORIGIN_COLS} FROM pairs p {ORIGIN_JOINS}",
)
def origin_lags(t: Tables):
    pairs = design.training_pairs(t.panel_s, t.weekly, CUT, H, STRIDE)
    out = design.build_design(t.panel_s, pairs, t.chunked)
    return out.select("unique_id", "o", "k", *(f"lag_{n}" for n in LAGS))


@query(
    "D5_origin_means", "panel_s",
    f"WITH p AS (SELECT unique_id, hidx AS o FROM panel_s) SELECT p.unique_id, p.o, {ROLLS} FROM p",
    digits="roll_4 roll_13",
)
def origin_means(t: Tables):
    return design.origin_features(t.panel_s, t.chunked).select("unique_id", "o", "roll_4", "roll_13")


@query(
    "D6_forecast_lags", "panel_s",
    f"WITH {PAIRS} SELECT p.unique_id, p.o, p.k, a.y AS wlag_26, b.y AS wlag_39, c.y AS wlag_52 FROM pairs p"
    + "".join(f" LEFT JOIN panel_s {x} ON {x}.unique_id = p.unique_id AND {x}.hidx = p.o + p.k - {n}" for x, n in (("a", 26), ("b", 39), ("c", 52))),
)
def forecast_lags(t: Tables):
    pairs = design.training_pairs(t.panel_s, t.weekly, CUT, H, STRIDE)
    out = design.build_design(t.panel_s, pairs, t.chunked, fc_lags=(26, 39, 52), horizon=H)
    return out.select("unique_id", "o", "k", "wlag_26", "wlag_39", "wlag_52")


@query(
    "D7_build_design", "panel_s",
    f"""WITH {PAIRS}, u AS (SELECT unique_id, row_number() OVER (ORDER BY unique_id) - 1 AS unit_id FROM (SELECT DISTINCT unique_id FROM panel_s)),
    o AS (SELECT p.*, {ORIGIN_COLS}, {ROLLS} FROM pairs p {ORIGIN_JOINS})
    SELECT o.unique_id, f.ds, o.o, o.k, {', '.join(f'lag_{n}' for n in LAGS)}, w.y AS wlag_39, roll_4, roll_13, o.k AS horizon_step,
      f.x1, f.capacity, f.zone, u.unit_id, f.y FROM o JOIN panel_s f ON f.unique_id = o.unique_id AND f.hidx = o.o + o.k
    LEFT JOIN panel_s w ON w.unique_id = o.unique_id AND w.hidx = o.o + o.k - 39 JOIN u ON u.unique_id = o.unique_id""",
    digits="roll_4 roll_13 x1",
)
def build_design(t: Tables):
    return design.training_design(
        t.panel_s, t.weekly, CUT, stride=STRIDE, horizon=H, futr=["x1"], statics=["capacity", "zone"], fc_lags=(39,), unit=True
    )


@query(
    "D8_recency_weights", "panel_s",
    f"WITH {PAIRS} SELECT unique_id, o, k, pow(0.5, (330 - o) / 52e0) AS w FROM pairs UNION ALL"
    " SELECT unique_id, NULL, k, 1 FROM pairs WHERE o = 317",
    digits="w",
)
def recency(t: Tables):
    pairs = design.training_pairs(t.panel_s, t.weekly, CUT, H, STRIDE)
    lost = pairs.filter("o = 317").withColumn("o", F.lit(None).cast("long"))
    return pairs.unionByName(lost).withColumn("w", design.recency_weight(CUT, 52.0))


@query(
    "D9_level_scaling", "panel_s",
    f"""WITH {PAIRS}, m AS (SELECT unique_id, median(y) AS v FROM panel_s WHERE hidx < 331 GROUP BY 1),
    l AS (SELECT unique_id, coalesce(CASE WHEN v > 0 THEN v END, (SELECT median(v) FROM m WHERE v > 0), 1) AS level FROM m)
    SELECT p.unique_id, p.o, p.k, f.y / level AS y, pow(0.5, (330 - p.o) / 52e0) * level AS weight FROM pairs p
    JOIN panel_s f ON f.unique_id = p.unique_id AND f.hidx = p.o + p.k JOIN l ON l.unique_id = p.unique_id""",
    digits="y weight",
)
def level_scaling(t: Tables):
    rows = design.training_design(t.panel_s, t.weekly, CUT, stride=STRIDE, horizon=H)
    rows = rows.withColumn("w", design.recency_weight(CUT, 52.0))
    levels = aggregates.unit_levels(t.panel_s, t.weekly, CUT)
    return design.scale_by_level(rows, levels, t.weekly, "w").select("unique_id", "o", "k", "y", "weight")


# ---------------------------------------------------------------- baselines


def window_rows(t: Tables):
    return index.horizons(t.panel_s.select("unique_id", "ds", "hidx"), t.weekly, CUTOFFS)


@query("B1f_last_value", "cube", "SELECT cutoff, unique_id, step, naive FROM cube")
def last_value(t: Tables):
    return baselines.last_value(window_rows(t), t.panel_s, t.weekly).select("cutoff", "unique_id", "step", "naive")


@query(
    "B2f_seasonal_naive", "cube",
    "SELECT cutoff, unique_id, step, seasonal_naive, CAST(NULL AS BIGINT) IS NULL AS full_season FROM cube UNION ALL"
    " SELECT 5, p.unique_id, p.hidx - 4, h.y, false FROM panel_s p JOIN panel_s h ON h.unique_id = p.unique_id AND h.hidx = (p.hidx - 5) % 5"
    " WHERE p.hidx >= 5 AND p.hidx < 31 UNION ALL SELECT 0, unique_id, hidx + 1, 0, false FROM panel_s WHERE hidx < 26",
)
def seasonal_naive(t: Tables):
    rows = t.panel_s.select("unique_id", "ds", "hidx")
    normal = baselines.seasonal_naive(window_rows(t), t.panel_s, t.weekly).withColumn("full_season", F.lit(True))
    # A history shorter than a season tiles what exists; none at all gives zero.
    short = baselines.seasonal_naive(index.horizons(rows, t.weekly, [5, 0]), t.panel_s, t.weekly).withColumn("full_season", F.lit(False))
    return normal.unionByName(short).select("cutoff", "unique_id", "step", "seasonal_naive", "full_season")


@query(
    "B3f_seasonal_mean", "cube",
    """SELECT cutoff, unique_id, step, seasonal_mean FROM cube UNION ALL
    SELECT 9, p.unique_id, p.hidx - 8, coalesce((SELECT avg(h.y) FROM panel_s h WHERE h.unique_id = p.unique_id AND h.hidx < 9 AND h.hidx % 13 = p.hidx % 13),
      (SELECT median(y) FROM panel_s WHERE hidx < 9)) FROM panel_s p WHERE p.hidx >= 9 AND p.hidx < 35""",
    digits="seasonal_mean",
)
def seasonal_mean(t: Tables):
    normal = baselines.seasonal_mean(window_rows(t), t.panel_s, t.weekly, CUTOFFS)
    rows = index.horizons(t.panel_s.select("unique_id", "ds", "hidx"), t.weekly, [9])
    early = baselines.seasonal_mean(rows, t.panel_s, t.weekly, [9])
    return normal.unionByName(early).select("cutoff", "unique_id", "step", "seasonal_mean")


@query(
    "B4f_lag_repeats", "panel_u",
    """SELECT unique_id, 552 + k AS hidx, week[145 + k % 24] AS lag24, week[1 + k] AS lag168
    FROM (SELECT unique_id, list(y ORDER BY hidx) AS week FROM panel_u WHERE hidx >= 384 AND hidx < 552 GROUP BY 1), (SELECT unnest(range(168)) AS k)
    WHERE 552 + k <= (SELECT max(hidx) FROM panel_u)""",
    digits="lag24 lag168",
)
def lag_repeats(t: Tables):
    rows = index.horizons(t.panel_u.select("unique_id", "ds", "hidx"), t.users, [552], 168)
    out = baselines.seasonal_naive(rows, t.panel_u, t.users, 24, "lag24")
    return baselines.seasonal_naive(out, t.panel_u, t.users, 168, "lag168").select("unique_id", "hidx", "lag24", "lag168")


# ---------------------------------------------------------------- blocks

BLOCKS26 = "p.hidx < 331 AND 331 - 26 * CAST(ceil((331 - p.hidx) / 26e0) AS BIGINT) > 0"
START26 = "331 - 26 * CAST(ceil((331 - p.hidx) / 26e0) AS BIGINT)"


@query(
    "R1_rolling_blocks", "panel_s",
    f"""WITH w AS (SELECT p.unique_id, p.hidx, p.y, {START26} AS cutoff FROM panel_s p WHERE {BLOCKS26})
    SELECT w.unique_id, w.hidx, CAST(w.cutoff AS BIGINT) AS cutoff,
      (SELECT avg(h.y) FROM panel_s h WHERE h.unique_id = w.unique_id AND h.hidx < w.cutoff AND h.hidx % 13 = w.hidx % 13) AS channel FROM w""",
    digits="channel",
)
def rolling_blocks(t: Tables):
    rows, _ = origin.roll_train(t.panel_s, t.weekly, CUT, 26, "seasonal_mean")
    return rows.select("unique_id", "hidx", "cutoff", "channel")


@query("R2_horizon_block", "cube", "SELECT unique_id, ds, seasonal_naive AS channel FROM cube WHERE cutoff = 331")
def horizon_block(t: Tables):
    return origin.forecast_horizon(t.panel_s, t.weekly, CUT, 26)[0].select("unique_id", "ds", "channel")


def drift(values: np.ndarray, h: int) -> np.ndarray:
    """Last value plus the mean step of the context."""
    slope = (values[-1] - values[0]) / max(1, len(values) - 1)
    return values[-1] + slope * np.arange(1, h + 1)


@query(
    "R3_pluggable_forecaster", "panel_s",
    """WITH b AS (SELECT CAST(s AS BIGINT) AS s, s + i AS hidx FROM (SELECT unnest([279, 305, 331]) AS s), range(26) r(i))
    SELECT p.unique_id, p.hidx, b.s AS cutoff, greatest(l.y + (l.y - f.y) / 51e0 * (p.hidx - b.s + 1), 0) AS channel
    FROM b JOIN panel_s p ON p.hidx = b.hidx JOIN panel_s l ON l.unique_id = p.unique_id AND l.hidx = s - 1
    JOIN panel_s f ON f.unique_id = p.unique_id AND f.hidx = s - 52""",
    digits="channel",
)
def pluggable(t: Tables):
    out = origin.forecast_blocks(t.panel_s, t.weekly, [(279, 26), (305, 26), (331, 26)], drift, context_rows=52)
    return out.select("unique_id", "hidx", "cutoff", "channel")


@query(
    "R4_rehost_stale", "panel_s",
    f"""WITH g AS (SELECT p.unique_id, p.hidx, CASE WHEN p.hidx < 318 THEN {START26.replace('331', '344')} ELSE 318 END AS s FROM panel_s p WHERE p.hidx < 344)
    SELECT p.unique_id, p.hidx, h.y AS channel FROM g p JOIN panel_s h ON h.unique_id = p.unique_id
     AND h.hidx = s - least(13, s) + (p.hidx - s) % least(13, s) WHERE s > 0""",
)
def rehost(t: Tables):
    spec = t.weekly
    base, blocks = origin.roll_train(t.panel_s, spec, 344, 26)
    out, _ = origin.rehost(
        base, spec, blocks, 318, 26, 344, "channel", lambda c, h: origin.forecast_horizon(t.panel_s, spec, c, h)[0]
    )
    return out.select("unique_id", "hidx", "channel")


@query("R5_rollout", "cube", "SELECT unique_id, step, seasonal_naive AS rollout FROM cube WHERE cutoff = 331")
def rollout(t: Tables):
    return members.rollout(t.panel_s, t.weekly, CUT, 26, 13).select("unique_id", "step", "rollout")


LONG = "UNPIVOT ({}) ON naive, seasonal_naive, seasonal_mean INTO NAME member VALUE p"
SIX_SQL = (
    "sum(abs(y - p)) / nullif(sum(abs(y)), 0) AS wape, avg(abs(y - p)) AS mae, avg(pow(y - p, 2)) AS mse, sqrt(avg(pow(y - p, 2))) AS rmse,"
    " avg(abs(y - p) / greatest(abs(y), 1e-8)) AS mape, avg(2 * abs(y - p) / greatest(abs(y) + abs(p), 1e-8)) AS smape"
)
SIX_DIGITS = {"wape": 6, "mae": 6, "mse": 5, "rmse": 6, "mape": 0, "smape": 6}


@query(
    "R6_contiguous_cv", "panel_s",
    f"""WITH w AS (SELECT p.unique_id, p.hidx, p.y, 357 - 13 * ((356 - p.hidx) // 13 + 1) AS cutoff FROM panel_s p WHERE p.hidx >= 318),
    f AS (SELECT w.*, l.y AS naive, s.y AS seasonal_naive FROM w JOIN panel_s l ON l.unique_id = w.unique_id AND l.hidx = w.cutoff - 1
      JOIN panel_s s ON s.unique_id = w.unique_id AND s.hidx = w.hidx - 13),
    m AS (UNPIVOT f ON naive, seasonal_naive INTO NAME member VALUE p),
    c AS (SELECT member, cutoff, sum(abs(y - p)) / sum(abs(y)) AS w FROM m GROUP BY 1, 2)
    SELECT a.*, n_folds, cv_wape_mean, cv_wape_std FROM (SELECT member, {SIX_SQL} FROM m GROUP BY 1) a
    JOIN (SELECT member, count(*) AS n_folds, avg(w) AS cv_wape_mean, stddev_pop(w) AS cv_wape_std FROM c GROUP BY 1) b USING (member)""",
    digits={**SIX_DIGITS, "cv_wape_mean": 6, "cv_wape_std": 6},
)
def contiguous_cv(t: Tables):
    rows = origin.contiguous_windows(t.panel_s.select("unique_id", "ds", "hidx", "y"), t.weekly, 3, 13, 357)
    out = baselines.seasonal_naive(baselines.last_value(rows, t.panel_s, t.weekly), t.panel_s, t.weekly)
    return evaluate.rolling_cv(out, t.weekly, ["naive", "seasonal_naive"])


# ---------------------------------------------------------------- metrics


def metric(name: str, cols: str, digits):
    query(
        name, "cube", f"SELECT member, {cols} FROM ({LONG.format('SELECT y, naive, seasonal_naive, seasonal_mean FROM scored')}) GROUP BY 1", digits=digits
    )(lambda t: _metric(t, tuple(digits)))


def _metric(t: Tables, names):
    long = M.long_members(t.scored, MEMBERS, ["y"])
    six = M.six(F.col("y"), F.col("yhat"))
    return long.groupBy("member").agg(*(six[n].alias(n) for n in names))


metric("M1_wape", "sum(abs(y - p)) / nullif(sum(abs(y)), 0) AS wape", {"wape": 6})
metric("M2_mae_mse_rmse", "avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse, sqrt(avg((y - p) * (y - p))) AS rmse", {"mae": 6, "mse": 5, "rmse": 6})
metric("M3_mape", "avg(abs(y - p) / greatest(abs(y), 1e-8)) AS mape", {"mape": 0})
metric("M4_smape", "avg(2 * abs(y - p) / greatest(abs(y) + abs(p), 1e-8)) AS smape", {"smape": 6})


@query(
    "M5_panel_metrics", "cube",
    f"""SELECT member, {SIX_SQL.replace('avg(abs(y - p) / greatest(abs(y), 1e-8)) AS mape', 'CASE WHEN bool_or(y = 0) THEN NULL ELSE avg(abs(y - p) / abs(y)) END AS mape')},
      round(avg(CAST(y = 0 AS DOUBLE)), 6) AS zero_frac, avg(abs(y - p) / y) FILTER (y <> 0) AS mape_nonzero,
      round(2 * avg(CAST(y = 0 AS DOUBLE)) / avg(2 * abs(y - p) / greatest(abs(y) + abs(p), 1e-8)), 4) AS smape_zero_share
    FROM ({LONG.format('SELECT y, naive, seasonal_naive, seasonal_mean FROM scored')}) GROUP BY 1""",
    digits={**SIX_DIGITS, "mape_nonzero": 6},
)
def panel_metrics(t: Tables):
    return evaluate.panel_metrics(t.scored, t.weekly, MEMBERS)


POOLED = (
    "SELECT member, cutoff, sum(abs(y - p)) AS ae, sum(abs(y)) AS ya, count(*) AS n_rows, sum(abs(y - p)) / sum(abs(y)) AS wape"
    f" FROM ({LONG.format('SELECT cutoff, y, naive, seasonal_naive, seasonal_mean FROM scored WHERE blk >= 9')}) GROUP BY GROUPING SETS ((member, cutoff), (member))"
)


@query("M6_pooled_wape", "cube", f"SELECT member, coalesce(cutoff, -1) AS cutoff, ae, ya, n_rows, wape FROM ({POOLED})", digits="ae ya wape")
def pooled_wape(t: Tables):
    out = evaluate.pooled_wape(t.scored, t.weekly, MEMBERS, "late")
    return out.withColumn("cutoff", F.coalesce("cutoff", F.lit(-1)))


HALVES = "SELECT cutoff, y, CASE WHEN step <= 13 THEN 'near' ELSE 'far' END AS horizon, naive, seasonal_naive, seasonal_mean FROM cube"


@query(
    "M7_metric_report", "cube",
    f"WITH l AS ({LONG.format(HALVES)}), r AS (SELECT horizon, cutoff, member, y, p FROM l UNION ALL SELECT 'all', cutoff, member, y, p FROM l),"
    f" a AS (SELECT horizon, cutoff, member, y, p FROM r UNION ALL SELECT horizon, -1, member, y, p FROM r)"
    f" SELECT member, horizon, cutoff, count(*) AS n_rows, {SIX_SQL} FROM a GROUP BY 1, 2, 3",
    digits=SIX_DIGITS,
)
def metric_report(t: Tables):
    out = evaluate.metric_report(t.cube, t.weekly, MEMBERS)
    return out.withColumn("cutoff", F.coalesce("cutoff", F.lit(-1)))


@query(
    "M8_skill_table", "cube",
    f"WITH p AS (SELECT member, wape FROM ({POOLED}) WHERE cutoff IS NULL) SELECT member, wape, 1 - wape / (SELECT wape FROM p WHERE member = 'seasonal_naive') AS skill FROM p",
    digits="wape skill",
)
def skill(t: Tables):
    return evaluate.skill_table(evaluate.pooled_wape(t.scored, t.weekly, MEMBERS, "late"))


@query(
    "M9_contamination_check", "cube",
    f"""WITH p AS (SELECT member, wape FROM ({POOLED}) WHERE cutoff IS NULL), r AS (SELECT (SELECT wape FROM p WHERE member = 'naive') AS plain_wape,
      (SELECT wape FROM p WHERE member = 'seasonal_mean') AS cascade_wape)
    SELECT *, (plain_wape - cascade_wape) / plain_wape AS lift,
      CASE WHEN (plain_wape - cascade_wape) / plain_wape > 2 * 0.083 THEN 'suspicious' ELSE 'consistent' END AS verdict FROM r""",
    digits="plain_wape cascade_wape lift",
)
def contamination(t: Tables):
    return evaluate.contamination_check(evaluate.pooled_wape(t.scored, t.weekly, MEMBERS, "late"), "naive", "seasonal_mean")


@query(
    "M10_score_offset", "cube",
    """WITH s AS (SELECT cutoff AS revision, 100 * sum(abs(y - seasonal_mean)) FILTER (blk >= 0) / sum(y) FILTER (blk >= 0) AS external,
      sum(abs(y - seasonal_mean)) FILTER (blk < 0) / sum(y) FILTER (blk < 0) AS cv FROM cube GROUP BY 1),
    o AS (SELECT a.*, external - 100 * cv AS "offset" FROM s a)
    SELECT 'seasonal_mean' AS member, a.revision, a.external, a.cv, a."offset", a."offset" - b."offset" AS offset_change, a.external - b.external AS external_change
    FROM o a LEFT JOIN o b ON b.revision = a.revision - 13""",
    digits={"external": 6, "cv": 6, '"offset"': 6, "offset_change": 6, "external_change": 6},
)
def score_offset(t: Tables):
    y, p = F.col("y"), F.col("seasonal_mean")
    near, far = F.col("blk") < 0, F.col("blk") >= 0

    def wape(rows):
        return F.sum(F.when(rows, F.abs(y - p))) / F.sum(F.when(rows, F.abs(y)))

    scores = t.cube.groupBy(F.col("cutoff").alias("revision")).agg((100 * wape(far)).alias("external"), wape(near).alias("cv"))
    return evaluate.score_offset(scores.withColumn("member", F.lit("seasonal_mean")))


@query(
    "M11_overfit_gap", "cube",
    """WITH c AS (SELECT cutoff, sum(abs(y - seasonal_mean)) / sum(abs(y)) AS w FROM scored GROUP BY 1),
    f AS (SELECT p.y, avg(p.y) OVER (PARTITION BY unique_id, hidx % 13) AS m FROM panel_s p WHERE hidx < 305),
    t AS (SELECT sum(abs(y - m)) / sum(abs(y)) AS w FROM f)
    SELECT 'seasonal_mean' AS member, (SELECT avg(w) FROM c) AS cv_wape, (SELECT w FROM t) AS train_wape, (SELECT avg(w) FROM c) - (SELECT w FROM t) AS gap""",
    digits="cv_wape train_wape gap",
)
def overfit(t: Tables):
    fit = t.panel_s.filter("hidx < 305").withColumns({"cutoff": F.lit(305).cast("long"), "step": F.col("hidx") - 305 + 1})
    seen = baselines.seasonal_mean(fit, t.panel_s, t.weekly, [305])
    cv = evaluate.pooled_wape(t.scored, t.weekly, ["seasonal_mean"], "full")
    return evaluate.overfit_gap(cv, evaluate.pooled_wape(seen, t.weekly, ["seasonal_mean"], "full"))
