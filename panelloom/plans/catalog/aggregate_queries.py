"""Aggregations: medians, statics, weights, coverage, seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions import quantiles
from panelloom.functions.exprs import ratio
from panelloom.operators import aggregates, blocks, calendar, evaluate
from panelloom.plans.registry import query
from panelloom.plans.tables import Tables


@query(
    "A1g_medians", "panel_s",
    "SELECT unique_id, median(x1) AS m1, median(x3) AS m3, (SELECT median(x1) FROM panel_s) AS g1, (SELECT median(x3) FROM panel_s) AS g3"
    " FROM panel_s GROUP BY 1",
    digits="m1 m3 g1 g3",
)
def medians(t: Tables):
    per = quantiles.grouped(t.panel_s, ["unique_id"], {"m1": ("x1", 0.5), "m3": ("x3", 0.5)}, bounded=t.weekly.bounded)
    overall = quantiles.pooled(t.panel_s, ["x1", "x3"])
    return per.withColumns({"g1": F.lit(overall["x1"]), "g3": F.lit(overall["x3"])})


@query("A2g_first_per_key", "panel_s", "SELECT unique_id, arg_min(capacity, ds) AS capacity, arg_min(x1, ds) FILTER (x1 IS NOT NULL) AS x1 FROM panel_s GROUP BY 1", digits="x1")
def first_per_key(t: Tables):
    return aggregates.static_frame(t.panel_s, t.weekly, ["capacity", "x1"])


@query(
    "A3g_volume_weight", "panel_s",
    """
    WITH m AS (SELECT unique_id, median(y) AS med FROM panel_s GROUP BY 1),
    d AS (SELECT unique_id, greatest(median(abs(y - med)), 1e-6) AS w FROM panel_s JOIN m USING (unique_id) GROUP BY 1)
    SELECT unique_id, hidx, w / (SELECT avg(w) FROM panel_s JOIN d USING (unique_id)) AS sample_weight FROM panel_s JOIN d USING (unique_id)
    """,
    digits="sample_weight",
)
def volume_weight(t: Tables):
    return aggregates.add_volume_weight(t.panel_s, t.weekly).select("unique_id", "hidx", "sample_weight")


@query(
    "A4g_unit_levels", "panel_s",
    """
    WITH m AS (SELECT unique_id, median(y) AS v FROM panel_s WHERE hidx < 331 GROUP BY 1),
    p AS (SELECT unique_id, CASE WHEN v > 0 THEN v END AS v FROM m)
    SELECT unique_id, coalesce(v, (SELECT median(v) FROM p), 1) AS level FROM p
    """,
    digits="level",
)
def unit_levels(t: Tables):
    return aggregates.unit_levels(t.panel_s, t.weekly, 331)


@query(
    "A5g_rectangle_check", "panel_s",
    "SELECT (SELECT count(DISTINCT unique_id) FROM panel_s) AS n_series, count(*) AS n_times,"
    " CAST(sum(CASE WHEN n <> (SELECT count(DISTINCT unique_id) FROM panel_s WHERE x1 IS NOT NULL) THEN 1 ELSE 0 END) AS BIGINT) AS ragged_times"
    " FROM (SELECT ds, count(DISTINCT unique_id) AS n FROM panel_s WHERE x1 IS NOT NULL GROUP BY 1)",
)
def rectangle(t: Tables):
    return blocks.rectangle_report(t.panel_s.filter("x1 IS NOT NULL"), t.weekly)


@query(
    "A6g_quantiles_spread", "panel_s",
    "SELECT hidx, quantile_cont(x3, 0.1) AS q10, quantile_cont(x3, 0.9) AS q90, stddev_samp(x3) AS sd, var_samp(x3) AS v,"
    " quantile_cont(x3, 0.75) - quantile_cont(x3, 0.25) AS iqr FROM panel_s GROUP BY 1",
    digits={"q10": 4, "q90": 4, "sd": 4, "v": 2, "iqr": 4},
)
def quantile_spread(t: Tables):
    wanted = {"q10": ("x3", 0.1), "q25": ("x3", 0.25), "q75": ("x3", 0.75), "q90": ("x3", 0.9)}
    q = quantiles.grouped(t.panel_s, ["hidx"], wanted, bounded=False)
    s = t.panel_s.groupBy("hidx").agg(F.stddev_samp("x3").alias("sd"), F.var_samp("x3").alias("v"))
    return q.join(s, "hidx").select("hidx", "q10", "q90", "sd", "v", (F.col("q75") - F.col("q25")).alias("iqr"))


@query(
    "A7g_window_sigma", "cube",
    "SELECT member, stddev_pop(w) AS sigma FROM (SELECT member, cutoff, sum(abs(y - p)) / sum(abs(y)) AS w FROM"
    " (UNPIVOT (SELECT cutoff, y, naive, seasonal_naive, seasonal_mean FROM scored) ON naive, seasonal_naive, seasonal_mean INTO NAME member VALUE p)"
    " GROUP BY 1, 2) GROUP BY 1",
    digits="sigma",
)
def window_sigma(t: Tables):
    from panelloom.plans.tables import MEMBERS

    return evaluate.window_sigma(evaluate.pooled_wape(t.scored, t.weekly, MEMBERS, "full"))


@query(
    "A8g_residual_correlation", "cube",
    "SELECT unique_id, CASE WHEN stddev_pop(seasonal_naive - y) > 0 AND stddev_pop(seasonal_mean - y) > 0"
    " THEN corr(seasonal_naive - y, seasonal_mean - y) END AS c FROM scored GROUP BY 1",
    digits="c",
)
def residual_correlation(t: Tables):
    y = F.col("y")
    return t.scored.groupBy("unique_id").agg(
        aggregates.residual_corr(F.col("seasonal_naive") - y, F.col("seasonal_mean") - y).alias("c")
    )


@query(
    "A9g_least_squares", "panel_s",
    """
    WITH p AS (SELECT ds, 1.25 + 0.003 * date_diff('hour', (SELECT min(ds) FROM panel_s), ds) AS trend FROM panel_s WHERE x1 IS NOT NULL),
    h AS (SELECT trend, date_diff('hour', (SELECT min(ds) FROM p), ds) AS h FROM p),
    f AS (SELECT regr_slope(trend, h) AS slope, regr_intercept(trend, h) AS intercept FROM h)
    SELECT slope, intercept, (SELECT max(abs(trend - (slope * h + intercept))) FROM h) < 1e-6 AS linear FROM f
    """,
    digits="slope intercept",
)
def least_squares(t: Tables):
    hours = F.timestamp_diff("HOUR", F.lit(t.weeks["lo"]).cast("timestamp"), F.col("ds"))
    rows = t.panel_s.filter("x1 IS NOT NULL").select("ds", (F.lit(1.25) + F.lit(0.003) * hours).alias("trend"))
    line = calendar.fit_trend(rows, "ds")
    worst = F.max(F.abs(F.col("trend") - line.at(F.col("ds"))))
    return rows.agg(F.lit(line.slope).alias("slope"), F.lit(line.intercept).alias("intercept"), (worst < 1e-6).alias("linear"))


@query(
    "A10g_composition", "panel_s",
    "SELECT 'zone' AS stratum, CAST(zone AS VARCHAR) AS value, count(*) AS n FROM panel_s GROUP BY zone UNION ALL"
    " SELECT 'active', CAST(CAST(y > 0 AS BIGINT) AS VARCHAR), count(*) FROM panel_s GROUP BY y > 0",
)
def composition(t: Tables):
    return aggregates.composition(t.panel_s.withColumn("active", (F.col("y") > 0).cast("long")), ["zone", "active"])


@query(
    "A11g_ratio_of_sums", "cube",
    "SELECT zone, sum(abs(c.y - seasonal_mean)) / sum(abs(c.y)) AS pooled, avg(abs(c.y - seasonal_mean) / c.y) FILTER (c.y > 0) AS mean_of_ratios"
    " FROM scored c JOIN (SELECT DISTINCT unique_id, zone FROM panel_s) z USING (unique_id) GROUP BY 1",
    digits="pooled mean_of_ratios",
)
def ratio_of_sums(t: Tables):
    zones = aggregates.static_frame(t.panel_s, t.weekly, ["zone"])
    e = F.abs(F.col("y") - F.col("seasonal_mean"))
    return t.scored.join(zones, "unique_id").groupBy("zone").agg(
        ratio(F.sum(e), F.sum(F.abs("y"))).alias("pooled"), F.avg(F.when(F.col("y") > 0, e / F.col("y"))).alias("mean_of_ratios")
    )


@query(
    "A12g_coverage", "panel_s",
    "SELECT 'x1' AS col, avg(CAST(x1 IS NULL AS DOUBLE)) AS missing_share, min(hidx) FILTER (x1 IS NOT NULL) AS first_seen FROM panel_s UNION ALL"
    " SELECT 'x3', avg(CAST(x3 IS NULL AS DOUBLE)), min(hidx) FILTER (x3 IS NOT NULL) FROM panel_s",
    digits="missing_share",
)
def coverage(t: Tables):
    return aggregates.coverage(t.panel_s, t.weekly, ["x1", "x3"])


@query(
    "A13g_seed_summary", "cube",
    """
    WITH w AS (SELECT cutoff, unnest([892, 7739, 6545, 4388, 4330]) AS seed, unnest([1.0, 1.1, 0.9, 1.2, 0.8]) AS f,
                      sum(abs(y - seasonal_mean)) / sum(abs(y)) AS s FROM scored GROUP BY cutoff),
    r AS (SELECT cutoff, seed, s * CAST(f AS DOUBLE) AS score FROM w)
    SELECT cutoff, count(DISTINCT seed) AS n_seeds, avg(score) AS mean, stddev_samp(score) AS std, stddev_pop(score) AS std_pop,
           min(score) AS min, max(score) AS max, max(score) - min(score) AS spread, count(DISTINCT seed) = 5 AS complete FROM r GROUP BY 1
    """,
    digits="mean std std_pop min max spread",
)
def seed_summary(t: Tables):
    from panelloom.functions import metrics as M

    scale = dict(zip(aggregates.FROZEN_SEEDS, (1.0, 1.1, 0.9, 1.2, 0.8)))
    runs = F.array(*(F.struct(F.lit(s).cast("long").alias("seed"), F.lit(f).alias("f")) for s, f in scale.items()))
    base = t.scored.groupBy("cutoff").agg(M.wape(F.col("y"), F.col("seasonal_mean")).alias("s"))
    rows = base.withColumn("_r", F.explode(runs)).select("cutoff", "_r.seed", (F.col("s") * F.col("_r.f")).alias("score"))
    return aggregates.summarize_seeds(rows, ["cutoff"])
