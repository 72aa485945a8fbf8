"""Projections, filters, joins, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelloom.functions import ordered, quantiles
from panelloom.functions.exprs import clip, hour_of_week
from panelloom.operators import calendar, index, provenance
from panelloom.plans.registry import query
from panelloom.plans.tables import CUTOFFS, MEMBERS, Tables
from panelloom.sources import panel_files

# ---------------------------------------------------------------- P: selection


@query(
    "P1_hour_index", "panel_s",
    """
    WITH seen AS (SELECT unique_id, ds FROM panel_s WHERE x1 IS NOT NULL)
    SELECT a.unique_id, a.ds, count(b.ds) AS hidx FROM seen a
    LEFT JOIN seen b ON a.unique_id = b.unique_id AND b.ds < a.ds GROUP BY a.unique_id, a.ds
    """,
)
def hour_index(t: Tables):
    seen = t.panel_s.filter("x1 IS NOT NULL").select("unique_id", "ds")
    return index.add_index(seen, t.chunked)


@query("P1_step_index", "panel_s", "SELECT unique_id, ds, (date_diff('day', min(ds) OVER (PARTITION BY unique_id), ds) // 7) AS _sidx FROM panel_s")
def step_index(t: Tables):
    return index.add_index(t.panel_s.select("unique_id", "ds"), t.weekly, "_sidx")


@query("P2_gapped_horizon", "panel_s", "SELECT unique_id, hidx, y FROM panel_s WHERE hidx BETWEEN 305 AND 330")
def gapped_horizon(t: Tables):
    return index.gapped_horizon(t.panel_s, t.weekly, 305).select("unique_id", "hidx", "y")


@query(
    "P3_window_cutoffs", "panel_s",
    "SELECT p.unique_id, p.hidx, CAST(331 - 13 * i AS BIGINT) AS cutoff, p.hidx - (331 - 13 * i) + 1 AS step"
    " FROM panel_s p JOIN range(3) r(i) ON p.hidx >= 331 - 13 * i AND p.hidx < 331 - 13 * i + 26",
)
def window_cutoffs(t: Tables):
    rows = t.panel_s.select("unique_id", "hidx")
    return index.horizons(rows, t.weekly, t.weekly.cutoffs(3))


@query(
    "P4_take_block_far", "panel_s",
    "SELECT unique_id, hidx, y FROM panel_s QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) <= 13",
)
def take_far(t: Tables):
    return index.take_block(t.panel_s, t.weekly, "far").select("unique_id", "hidx", "y")


@query(
    "P4_take_block_near", "panel_s",
    "SELECT unique_id, hidx, y FROM panel_s QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ds) <= 13",
)
def take_near(t: Tables):
    return index.take_block(t.panel_s, t.weekly, "near").select("unique_id", "hidx", "y")


@query(
    "P5_block_index", "cube",
    "SELECT cutoff, unique_id, ds, row_number() OVER (PARTITION BY cutoff, unique_id ORDER BY ds) - 1 AS blk FROM scored",
)
def block_index(t: Tables):
    return index.add_block_index(t.scored.select("cutoff", "unique_id", "ds"), t.weekly)


@query("P6_select_regime", "cube", "SELECT cutoff, unique_id, ds, blk FROM cube WHERE blk >= 9")
def late_regime(t: Tables):
    return index.select_regime(t.scored.select("cutoff", "unique_id", "ds", "blk"), t.weekly, "late")


@query(
    "P7_select_horizon", "cube",
    "SELECT 'near' AS horizon, cutoff, unique_id, step FROM cube WHERE step <= 13"
    " UNION ALL SELECT 'far', cutoff, unique_id, step FROM cube WHERE step > 13",
)
def near_far(t: Tables):
    rows = t.cube.select("cutoff", "unique_id", "step")
    parts = [index.select_horizon(rows, t.weekly, h).withColumn("horizon", F.lit(h)) for h in ("near", "far")]
    return parts[0].unionByName(parts[1])


@query(
    "P8_gapped_split", "panel_s",
    """
    WITH seen AS (SELECT unique_id, ds, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS i,
                         count(*) OVER (PARTITION BY unique_id) AS n FROM panel_s WHERE x1 IS NOT NULL),
    g AS (SELECT CASE WHEN min(n) >= 42 THEN 13 ELSE greatest(2, (min(n) - 16) // 2) END AS h FROM seen)
    SELECT unique_id, ds, CASE WHEN i < n - 2 * h THEN 'train' WHEN i < n - h THEN 'gap' ELSE 'score' END AS part,
           i >= n - h AS is_scored FROM seen, g
    """,
)
def gapped_split(t: Tables):
    seen = t.panel_s.filter("x1 IS NOT NULL").select("unique_id", "ds")
    out = index.gapped_split(seen, t.weekly, 13)
    return out.select("unique_id", "ds", "part", "is_scored")


@query(
    "P9_conditioning_set", "panel_s",
    "SELECT unique_id, hidx, x1, x2, x3, CAST(x1 IS NULL AS DOUBLE) AS x1_missing, CAST(x2 IS NULL AS DOUBLE) AS x2_missing,"
    " CAST(x3 IS NULL AS DOUBLE) AS x3_missing FROM panel_s",
    digits="x1 x2 x3",
)
def conditioning_set(t: Tables):
    from panelloom.operators.impute import MISSING, add_indicators

    flagged = add_indicators(t.panel_s, t.weekly.nullable)
    flags = [f"{c}{MISSING}" for c in t.weekly.nullable]
    cols = index.compose_columns([], t.weekly.signals, flags)
    return flagged.select("unique_id", "hidx", *cols)


@query(
    "P10_bag_columns", "cube",
    "SELECT cutoff, unique_id, step, naive AS m, seasonal_naive AS m1, seasonal_mean AS m2 FROM cube",
    digits="m m1 m2",
)
def bag(t: Tables):
    named = t.cube.select(
        "cutoff", "unique_id", "step", F.col("seasonal_mean").alias("m2"), F.col("naive").alias("m"),
        F.col("seasonal_naive").alias("m1"), F.col("naive").alias("m-lo-90"), F.col("naive").alias("m_median"),
    )
    return named.select("cutoff", "unique_id", "step", *index.bag_columns(named.columns, "m"))


@query(
    "P11_first_series", "panel_s",
    "SELECT unique_id, hidx, y FROM panel_s WHERE unique_id IN (SELECT DISTINCT unique_id FROM panel_s ORDER BY 1 LIMIT 7)",
)
def first_series(t: Tables):
    return index.first_series(t.panel_s, t.weekly, 7).select("unique_id", "hidx", "y")


@query(
    "P12_guard_predictions", "panel_s",
    """
    WITH raw AS (SELECT unique_id, hidx, CASE WHEN x1 IS NULL THEN NULL ELSE y - 20 END AS p FROM panel_s),
    c AS (SELECT unique_id, hidx, CASE WHEN p < 0 THEN 0 ELSE p END AS p FROM raw)
    SELECT unique_id, hidx, coalesce(p, (SELECT median(p) FROM c)) AS p FROM c
    """,
    digits="p",
)
def guard(t: Tables):
    # Unavailable predictions reach the guard as NaN and infinity, not only as NULL.
    broken = F.when(F.col("hidx") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    raw = t.panel_s.select("unique_id", "hidx", F.when(F.col("x1").isNull(), broken).otherwise(F.col("y") - 20).alias("p"))
    return index.guard_predictions(raw, "p")


@query("P13_frame_tag", "cube", "SELECT 'median' AS nan_fill, 13 AS block, cutoff, count(*) AS n_rows FROM scored GROUP BY cutoff")
def frame_tag(t: Tables):
    tagged = t.scored.withColumns({"nan_fill": F.lit("median"), "block": F.lit(t.weekly.score_len)})
    return tagged.groupBy("nan_fill", "block", "cutoff").agg(F.count(F.lit(1)).alias("n_rows"))


@query("P14_patch_trim", "panel_s", "SELECT unique_id, hidx, y FROM panel_s WHERE hidx >= (SELECT count(DISTINCT hidx) % 32 FROM panel_s)")
def patch_trim(t: Tables):
    return index.trim_to_patches(t.panel_s, t.weekly, 32).select("unique_id", "hidx", "y")


@query(
    "P15_evaluation_modes", "panel_s",
    "SELECT 'gapped-real' AS mode, unique_id, hidx FROM panel_s WHERE hidx BETWEEN 318 AND 330"
    " UNION ALL SELECT 'gapped-withheld', unique_id, hidx FROM panel_s WHERE hidx BETWEEN 318 AND 330"
    " UNION ALL SELECT 'contiguous', unique_id, hidx FROM panel_s WHERE hidx BETWEEN 318 AND 330",
)
def modes(t: Tables):
    rows = t.panel_s.select("unique_id", "hidx")
    parts = [index.mode_rows(rows, t.weekly, m, 305) for m in index.MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- J: joins


@query(
    "J1_left_join_covariates", "panel_s",
    "SELECT c.cutoff + 0 AS cutoff, p.unique_id, p.hidx, p.x1, p.x3 FROM panel_s p"
    " JOIN (SELECT CAST(unnest([331, 318, 305]) AS BIGINT) AS cutoff) c ON p.hidx >= c.cutoff AND p.hidx < c.cutoff + 26",
    digits="x1 x3",
)
def join_covariates(t: Tables):
    wanted = index.horizons(t.panel_s.select("unique_id", "ds", "hidx"), t.weekly, CUTOFFS)
    cov = t.panel_s.filter("x1 IS NOT NULL").select("unique_id", "ds", "x1", "x3")
    return wanted.join(cov, ["unique_id", "ds"], "left").select("cutoff", "unique_id", "hidx", "x1", "x3")


@query(
    "J2_assign_predictions", "cube",
    "SELECT unique_id, ds, seasonal_mean AS pred, row_number() OVER (ORDER BY md5(unique_id || ':' || hidx), unique_id, hidx) AS pos"
    " FROM cube WHERE cutoff = 331 AND step > 13",
    digits="pred",
)
def assign(t: Tables):
    block = t.stored.filter("cutoff = 331")
    key = F.md5(F.concat_ws(":", "unique_id", F.col("hidx").cast("string")))
    # The requested order is arbitrary; the join must find its rows by key and keep that order.
    asked = block.filter("step > 13").select("unique_id", "ds", key.alias("_k"), "hidx")
    asked = ordered.global_index(asked.withColumnRenamed("hidx", "_h"), ["_k", "unique_id", "_h"], "_order")
    preds = block.select("unique_id", "ds", F.col("seasonal_mean").alias("pred"))
    out = panel_files.assign_predictions(asked, preds, ["unique_id", "ds"], "pred")
    place = F.row_number().over(Window.partitionBy("_g").orderBy("_k", "unique_id", "_h"))
    sizes = out.withColumn("_g", F.substring("_k", 1, 2))
    counts = sizes.groupBy("_g").count()
    before = Window.partitionBy(F.lit(0)).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_g", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s"))
    return sizes.withColumn("_p", place).join(starts, "_g").select(
        "unique_id", "ds", "pred", (F.col("_s") + F.col("_p")).alias("pos")
    )


@query(
    "J3_member_cube_join", "cube",
    "SELECT cutoff, unique_id, ds, y, naive, seasonal_naive, seasonal_mean FROM scored",
    digits="naive seasonal_naive seasonal_mean",
)
def member_join(t: Tables):
    from panelloom.operators.assembly import join_members

    keys = ["cutoff", "unique_id", "ds", "y"]
    return join_members({m: t.stored_scored.select(*keys, m) for m in MEMBERS}, keys)


@query("J4_static_join", "panel_s", "SELECT unique_id, hidx, capacity, zone FROM panel_s WHERE hidx >= 331")
def static_join(t: Tables):
    from panelloom.operators.aggregates import static_frame

    statics = static_frame(t.panel_s, t.weekly, ["capacity", "zone"])
    block = index.gapped_horizon(t.panel_s, t.weekly, 331).select("unique_id", "hidx")
    return block.join(statics, "unique_id")


@query(
    "J5_label_join", "cube",
    "SELECT c.cutoff, c.unique_id, c.ds, c.seasonal_mean AS pred, p.y FROM scored c JOIN panel_s p USING (unique_id, ds)",
    digits="pred",
)
def label_join(t: Tables):
    from panelloom.operators.assembly import with_labels

    preds = t.scored.select("cutoff", "unique_id", "ds", F.col("seasonal_mean").alias("pred"))
    return with_labels(preds, t.panel_s, t.weekly)


@query(
    "J6_context_end", "panel_s",
    """
    WITH b AS (SELECT CAST(unnest([0, 39, 78, 117, 331, 318]) AS BIGINT) AS s, unnest([39, 39, 39, 60, 26, 13]) AS n)
    SELECT 'channel' AS "column", h.hidx AS hour, CAST((SELECT max(s) - 1 FROM b WHERE s <= h.hidx AND h.hidx < s + n) AS DOUBLE) AS context_end
    FROM (SELECT DISTINCT hidx FROM panel_s) h
    """,
)
def context_end(t: Tables):
    blocks = [(0, 39), (39, 39), (78, 39), (117, 60), (331, 26), (318, 13)]
    prov = provenance.table(t.spark, "channel", blocks, t.weekly.series_len)
    hours = t.panel_s.select(F.lit("channel").alias("column"), F.col("hidx").alias("hour")).distinct()
    return provenance.context_ends(prov, hours).withColumn("context_end", F.col("context_end").cast("double"))


@query(
    "J7_origin_step", "cube",
    "SELECT unique_id, CAST(cutoff - 1 AS BIGINT) AS o, step AS k, y - seasonal_mean AS residual FROM cube",
    digits="residual",
)
def origin_step(t: Tables):
    from panelloom.operators.design import residual_samples

    # Cutoffs arrive as timestamps of the last train row and are mapped back to positions.
    start = t.panel_s.select("unique_id", F.col("hidx").alias("_o"), F.col("ds").alias("_cut"))
    oof = t.cube.withColumn("_o", F.col("cutoff") - 1).join(start, ["unique_id", "_o"])
    oof = oof.select("unique_id", "ds", F.col("_cut").alias("cutoff"), "y", "seasonal_mean")
    return residual_samples(oof, t.panel_s, t.weekly, "seasonal_mean")


@query(
    "J8_map_lookup", "panel_s",
    "SELECT unique_id, hidx, coalesce(m.v, 0) AS level FROM panel_s LEFT JOIN"
    " (SELECT unique_id, max(y) AS v FROM panel_s WHERE zone <> 2 GROUP BY 1) m USING (unique_id)",
)
def map_lookup(t: Tables):
    table = t.panel_s.filter("zone <> 2").groupBy("unique_id").agg(F.max("y").alias("_v"))
    return t.panel_s.join(table, "unique_id", "left").select("unique_id", "hidx", F.coalesce("_v", F.lit(0.0)).alias("level"))


@query(
    "J9_channel_merge", "cube",
    "SELECT p.unique_id, p.ds, p.y, max(naive) FILTER (cutoff = 331) AS ch_a, max(seasonal_mean) FILTER (cutoff = 318) AS ch_b,"
    " max(seasonal_mean) FILTER (cutoff = 305) AS ch_c FROM panel_s p LEFT JOIN cube c ON c.unique_id = p.unique_id AND c.ds = p.ds GROUP BY ALL",
    digits="ch_a ch_b ch_c",
)
def channel_merge(t: Tables):
    made = (("ch_a", 331, "naive"), ("ch_b", 318, "seasonal_mean"), ("ch_c", 305, "seasonal_mean"))
    channels = {n: t.cube.filter(F.col("cutoff") == c).select("unique_id", "ds", F.col(m).alias(n)) for n, c, m in made}
    return panel_files.merge_channels(t.panel_s.select("unique_id", "ds", "y"), channels, ["unique_id", "ds"])


# ---------------------------------------------------------------- W: windows


@query(
    "W1_cumcount", "panel_s",
    "SELECT unique_id, ds, count(*) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n"
    " FROM panel_s WHERE y > 20",
)
def cumcount(t: Tables):
    return index.add_index(t.panel_s.filter("y > 20").select("unique_id", "ds"), t.chunked, "n")


@query(
    "W2_shift", "panel_s",
    "SELECT p.unique_id, p.hidx, a.y AS lag1, b.y AS lag13, c.y AS lead4 FROM panel_s p"
    " LEFT JOIN panel_s a ON a.unique_id = p.unique_id AND a.hidx = p.hidx - 1"
    " LEFT JOIN panel_s b ON b.unique_id = p.unique_id AND b.hidx = p.hidx - 13"
    " LEFT JOIN panel_s c ON c.unique_id = p.unique_id AND c.hidx = p.hidx + 4",
)
def shift(t: Tables):
    y = F.col("y")
    rows = t.panel_s.select("unique_id", "hidx", "y")
    return ordered.lagged(rows, t.chunked, {"lag1": (y, 1), "lag13": (y, 13), "lead4": (y, -4)}).drop("y")


@query(
    "W3_trailing_mean", "panel_s",
    "SELECT a.unique_id, a.hidx, avg(CASE WHEN b.hidx > a.hidx - 4 THEN b.y END) AS r4, avg(b.y) AS r13 FROM panel_s a"
    " JOIN panel_s b ON a.unique_id = b.unique_id AND b.hidx BETWEEN a.hidx - 12 AND a.hidx GROUP BY 1, 2",
    digits="r4 r13",
)
def trailing_mean(t: Tables):
    y = F.col("y")
    rows = t.panel_s.select("unique_id", "hidx", "y")
    return ordered.rolling_mean(rows, t.chunked, {"r4": (y, 4), "r13": (y, 13)}, centred=False).drop("y")


@query(
    "W4_centred_mean", "panel_s",
    "SELECT a.unique_id, a.hidx, avg(CASE WHEN b.hidx BETWEEN a.hidx - 1 AND a.hidx + 1 THEN b.x1 END) AS c3,"
    " avg(CASE WHEN b.hidx BETWEEN a.hidx - 6 AND a.hidx + 5 THEN b.x1 END) AS c12 FROM panel_s a"
    " JOIN panel_s b ON a.unique_id = b.unique_id AND b.hidx BETWEEN a.hidx - 6 AND a.hidx + 5 GROUP BY 1, 2",
    digits="c3 c12",
)
def centred_mean(t: Tables):
    x = F.col("x1")
    rows = t.panel_s.select("unique_id", "hidx", "x1")
    return ordered.rolling_mean(rows, t.chunked, {"c3": (x, 3), "c12": (x, 12)}, centred=True).drop("x1")


@query(
    "W5_backward_ewma", "panel_s",
    """
    WITH RECURSIVE e AS (
      SELECT unique_id, hidx, y AS s6, y AS s24 FROM panel_s WHERE hidx = 0
      UNION ALL
      SELECT p.unique_id, p.hidx, e.s6 * pow(0.5, 1 / 6e0) + p.y * (1 - pow(0.5, 1 / 6e0)),
             e.s24 * pow(0.5, 1 / 24e0) + p.y * (1 - pow(0.5, 1 / 24e0))
      FROM e JOIN panel_s p ON p.unique_id = e.unique_id AND p.hidx = e.hidx + 1)
    SELECT p.unique_id, p.hidx, q.s6 AS ew6, q.s24 AS ew24 FROM panel_s p
    LEFT JOIN e q ON q.unique_id = p.unique_id AND q.hidx = p.hidx - 1
    """,
    digits="ew6 ew24",
)
def backward_ewma(t: Tables):
    y = F.col("y")
    out = ordered.ewma(t.panel_s.select("unique_id", "hidx", "y"), t.chunked, {"s6": (y, 6.0), "s24": (y, 24.0)})
    out = ordered.lagged(out, t.chunked, {"ew6": (F.col("s6"), 1), "ew24": (F.col("s24"), 1)})
    return out.select("unique_id", "hidx", "ew6", "ew24")


@query(
    "W6_forward_backward_fill", "panel_s",
    """
    SELECT p.unique_id, p.hidx,
      (SELECT arg_max(q.x1, q.hidx) FROM panel_s q WHERE q.unique_id = p.unique_id AND q.hidx <= p.hidx AND q.x1 IS NOT NULL) AS f,
      (SELECT arg_min(q.x1, q.hidx) FROM panel_s q WHERE q.unique_id = p.unique_id AND q.hidx >= p.hidx AND q.x1 IS NOT NULL) AS b
    FROM panel_s p
    """,
    digits="f b",
)
def fills(t: Tables):
    rows = t.panel_s.select("unique_id", "hidx", "x1")
    out = ordered.carried(rows, t.chunked, {"f": F.col("x1")})
    return ordered.carried(out, t.chunked, {"b": F.col("x1")}, backward=True).drop("x1")


@query(
    "W7_inside_interpolation", "panel_s",
    """
    WITH n AS (
      SELECT p.unique_id, p.hidx, p.x3,
        (SELECT max(q.hidx) FROM panel_s q WHERE q.unique_id = p.unique_id AND q.hidx <= p.hidx AND q.x3 IS NOT NULL) AS a,
        (SELECT min(q.hidx) FROM panel_s q WHERE q.unique_id = p.unique_id AND q.hidx >= p.hidx AND q.x3 IS NOT NULL) AS b
      FROM panel_s p)
    SELECT n.unique_id, n.hidx, CASE WHEN n.a = n.b THEN n.x3
             ELSE l.x3 + (r.x3 - l.x3) / (n.b - n.a) * (n.hidx - n.a) END AS x3
    FROM n LEFT JOIN panel_s l ON l.unique_id = n.unique_id AND l.hidx = n.a
           LEFT JOIN panel_s r ON r.unique_id = n.unique_id AND r.hidx = n.b
    """,
    digits={"x3": 4},
)
def interpolation(t: Tables):
    rows = t.panel_s.select("unique_id", "hidx", F.col("x3").alias("v"))
    return ordered.interpolated(rows, t.chunked, {"x3": F.col("v")}).drop("v")


@query(
    "W8_percent_rank", "panel_s",
    "SELECT a.unique_id, a.hidx, (count(*) FILTER (b.y < a.y) + (count(*) FILTER (b.y = a.y) + 1) / 2e0) / count(*) AS pct"
    " FROM panel_s a JOIN panel_s b ON a.hidx = b.hidx GROUP BY 1, 2",
    digits="pct",
)
def percent_rank(t: Tables):
    rows = t.panel_s.select("unique_id", "hidx", "y")
    return quantiles.average_rank(rows, ["hidx"], "y", "pct").drop("y")


@query(
    "W9_recency_rank", "panel_s",
    "SELECT unique_id, hidx, row_number() OVER (PARTITION BY unique_id ORDER BY hidx DESC) AS age FROM panel_s"
    " WHERE x1 IS NOT NULL AND hidx < 331",
)
def recency_rank(t: Tables):
    seen = t.panel_s.filter("x1 IS NOT NULL AND hidx < 331").select("unique_id", "ds", "hidx")
    ranked = ordered.row_index(seen, t.chunked, "_i")
    sizes = ranked.groupBy("unique_id").agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(sizes, "unique_id").select("unique_id", "hidx", (F.col("_n") - F.col("_i")).alias("age"))


@query(
    "W10_group_broadcast", "panel_s",
    "SELECT unique_id, hidx, median(x2) OVER (PARTITION BY unique_id) AS med FROM panel_s",
    digits="med",
)
def group_broadcast(t: Tables):
    table = quantiles.grouped(t.panel_s, ["unique_id"], {"med": ("x2", 0.5)}, bounded=t.weekly.bounded)
    return t.panel_s.join(table, "unique_id").select("unique_id", "hidx", "med")


@query(
    "W11_differences", "panel_s",
    "SELECT p.unique_id, avg(abs(p.y - a.y)) AS d1, avg(abs(p.y - b.y)) AS d13, var_samp(p.y - b.y) AS v13 FROM panel_s p"
    " LEFT JOIN panel_s a ON a.unique_id = p.unique_id AND a.hidx = p.hidx - 1"
    " LEFT JOIN panel_s b ON b.unique_id = p.unique_id AND b.hidx = p.hidx - 13 GROUP BY 1",
    digits="d1 d13 v13",
)
def differences(t: Tables):
    y = F.col("y")
    out = ordered.lagged(t.panel_s.select("unique_id", "hidx", "y"), t.chunked, {"a": (y, 1), "b": (y, 13)})
    return out.groupBy("unique_id").agg(
        F.avg(F.abs(y - F.col("a"))).alias("d1"), F.avg(F.abs(y - F.col("b"))).alias("d13"), F.var_samp(y - F.col("b")).alias("v13")
    )


@query(
    "W12_head_tail", "panel_s",
    "SELECT unique_id, hidx, 'head' AS part FROM panel_s WHERE hidx < 5"
    " UNION ALL SELECT unique_id, hidx, 'tail' FROM panel_s WHERE hidx >= (SELECT max(hidx) - 4 FROM panel_s)",
)
def head_tail(t: Tables):
    rows = t.panel_s.select("unique_id", "ds", "hidx")
    head = index.take_block(rows, t.weekly, "near", 5).withColumn("part", F.lit("head"))
    tail = index.take_block(rows, t.weekly, "far", 5).withColumn("part", F.lit("tail"))
    return head.unionByName(tail).drop("ds")


# ---------------------------------------------------------------- O, U: order and sets


@query("O1_canonical_sort", "cube", "SELECT cutoff, unique_id, ds, y FROM scored ORDER BY cutoff, unique_id, ds")
def canonical(t: Tables):
    return index.canonical(t.scored.select("cutoff", "unique_id", "ds", "y"), t.weekly)


@query(
    "O2_top_combinations", "cube",
    """
    WITH s AS (SELECT sum(abs(y)) AS ya, sum(abs(y - naive)) AS n, sum(abs(y - seasonal_naive)) AS sn, sum(abs(y - seasonal_mean)) AS sm,
      sum(abs(y - (naive + seasonal_naive) / 2)) AS n_sn, sum(abs(y - (naive + seasonal_mean) / 2)) AS n_sm,
      sum(abs(y - (seasonal_naive + seasonal_mean) / 2)) AS sn_sm, sum(abs(y - (naive + seasonal_naive + seasonal_mean) / 3)) AS n_sn_sm FROM scored),
    c AS (SELECT 1 AS size, 'naive' AS members, n / ya AS wape FROM s UNION ALL SELECT 1, 'seasonal_naive', sn / ya FROM s
      UNION ALL SELECT 1, 'seasonal_mean', sm / ya FROM s UNION ALL SELECT 2, 'naive+seasonal_naive', n_sn / ya FROM s
      UNION ALL SELECT 2, 'naive+seasonal_mean', n_sm / ya FROM s UNION ALL SELECT 2, 'seasonal_naive+seasonal_mean', sn_sm / ya FROM s
      UNION ALL SELECT 3, 'naive+seasonal_naive+seasonal_mean', n_sn_sm / ya FROM s)
    SELECT CAST(size AS BIGINT) AS size, members, wape, row_number() OVER (PARTITION BY size ORDER BY wape, members) AS rank
    FROM c QUALIFY rank <= 10
    """,
    digits="wape",
)
def top_combinations(t: Tables):
    from panelloom.operators.blend import combination_means

    table = combination_means(t.scored, t.weekly, MEMBERS, (1, 2, 3))
    return index.ranked_within(table, ["size"], [F.col("wape"), F.col("members")], 10)


@query(
    "O3_top_units", "cube",
    "SELECT unique_id, sum(abs(y - seasonal_mean)) AS ae FROM scored GROUP BY 1 ORDER BY round(ae, 6) DESC, unique_id LIMIT 10",
    digits="ae",
)
def top_units(t: Tables):
    from panelloom.operators.aggregates import error_share

    units = error_share(t.scored, t.weekly, "seasonal_mean").select("unique_id", F.round("ae", 6).alias("ae"))
    return units.orderBy(F.desc("ae"), "unique_id").limit(10)


@query(
    "O4_grid_argmin", "cube",
    """
    WITH g AS (SELECT i, sum(abs(y - (i / 1e2 * seasonal_naive + (1 - i / 1e2) * seasonal_mean))) / sum(abs(y)) AS wape
               FROM scored, range(101) r(i) GROUP BY i)
    SELECT i / 1e2 AS value, wape AS fit_wape FROM g ORDER BY wape, i LIMIT 1
    """,
    digits="value fit_wape",
)
def grid_argmin(t: Tables):
    from panelloom.operators import blend

    return blend.grid_fit(t.stored_scored, t.weekly, blend.grid(101), blend.pair_text("seasonal_naive", "seasonal_mean"))


@query(
    "U1_union_by_name", "panel_s",
    "SELECT unique_id, hidx, y, 'history' AS part FROM panel_s WHERE hidx < 331 UNION ALL"
    " SELECT unique_id, hidx, NULL, 'horizon' FROM panel_s WHERE hidx >= 331",
)
def union_by_name(t: Tables):
    history = t.panel_s.filter("hidx < 331").select("unique_id", "hidx", "y", F.lit("history").alias("part"))
    horizon = t.panel_s.filter("hidx >= 331").select(F.lit("horizon").alias("part"), "hidx", "unique_id")
    return history.unionByName(horizon, allowMissingColumns=True)


@query("U2_distinct_keys", "cube", "SELECT DISTINCT unique_id, ds FROM cube")
def distinct_keys(t: Tables):
    return t.cube.select("unique_id", "ds", "cutoff").dropDuplicates(["unique_id", "ds"]).select("unique_id", "ds")


@query(
    "U3_duplicate_keys", "cube",
    "SELECT count(*) AS n_rows, count(DISTINCT unique_id || '|' || ds) AS n_keys,"
    " count(*) - count(DISTINCT unique_id || '|' || ds) AS duplicates FROM cube",
)
def duplicate_keys(t: Tables):
    from panelloom.operators.evaluate import duplicate_report

    return duplicate_report(t.cube, ["unique_id", "ds"])


@query(
    "U4_window_intersection", "cube",
    "SELECT cutoff, unique_id, ds FROM scored WHERE cutoff IN (SELECT cutoff FROM scored WHERE cutoff >= 318 INTERSECT"
    " SELECT cutoff FROM scored WHERE cutoff <= 318)",
)
def window_intersection(t: Tables):
    from panelloom.operators.assembly import shared_windows

    a, b = t.scored.filter("cutoff >= 318"), t.scored.filter("cutoff <= 318")
    return shared_windows(a.select("cutoff", "unique_id", "ds"), b)


@query(
    "U5_combinations", "cube",
    """
    WITH s AS (SELECT member AS m, count(*) AS n, sum(abs(y - p)) AS ae FROM (UNPIVOT scored ON naive, seasonal_naive, seasonal_mean INTO NAME member VALUE p) GROUP BY 1),
    m AS (SELECT m, n, row_number() OVER (ORDER BY m) AS i FROM s),
    c AS (SELECT a.m || '+' || b.m AS members, 2 AS size, least(a.n, b.n) AS n_rows FROM m a JOIN m b ON a.i < b.i UNION ALL
          SELECT a.m || '+' || b.m || '+' || c.m, 3, least(a.n, b.n, c.n) FROM m a JOIN m b ON a.i < b.i JOIN m c ON b.i < c.i)
    SELECT members, CAST(size AS BIGINT) AS size, n_rows FROM c
    """,
)
def combos(t: Tables):
    from panelloom.operators.blend import combinations_of

    # The members are those the cube holds forecasts of, the rows those that all of a combination forecast.
    known = t.scored.agg(*(F.count(m).alias(m) for m in sorted(set(t.scored.columns) & set(MEMBERS)))).first().asDict()
    names = combinations_of([m for m, n in known.items() if n], (2, 3))
    rows = t.scored.agg(*(F.count_if(F.forall(F.array(*c), lambda x: x.isNotNull())).alias("+".join(c)) for c in names))
    cells = F.array(*(F.struct(F.lit("+".join(c)).alias("members"), F.lit(len(c)).cast("long").alias("size"), F.col(f"`{'+'.join(c)}`").alias("n_rows")) for c in names))
    return rows.select(F.inline(cells))


# ---------------------------------------------------------------- scalar functions


@query(
    "F1_calendar_functions", "panel_e",
    "SELECT unique_id, ds, CAST(hour(ds) AS BIGINT) AS h, CAST((dayofweek(ds) + 6) % 7 AS BIGINT) AS dow,"
    " CAST(((dayofweek(ds) + 6) % 7) * 24 + hour(ds) AS BIGINT) AS how, CAST(month(ds) AS BIGINT) AS mon,"
    " date_trunc('day', ds) AS day, CAST(date_diff('hour', (SELECT min(ds) FROM panel_e), ds) AS BIGINT) AS hours FROM panel_e",
)
def calendar_functions(t: Tables):
    ds = F.col("ds")
    return t.panel_e.select(
        "unique_id", "ds", F.hour(ds).cast("long").alias("h"), F.weekday(ds).cast("long").alias("dow"),
        hour_of_week(ds).cast("long").alias("how"), F.month(ds).cast("long").alias("mon"), F.date_trunc("day", ds).alias("day"),
        F.timestamp_diff("HOUR", F.timestamp_seconds(F.lit(t.hours[0])), ds).alias("hours"),
    )


@query(
    "F2_math_functions", "panel_s",
    "SELECT unique_id, hidx, sin(y) AS s, cos(y) AS c, sign(y - 25) AS g, pow(0.5, y / 10) AS p,"
    " least(greatest(y, 5), 40) AS k, floor(y / 7) AS f, round_even(capacity / 3, 4) AS e, abs(y - 30) AS a FROM panel_s",
    digits="s c p e",
)
def math_functions(t: Tables):
    y = F.col("y")
    return t.panel_s.select(
        "unique_id", "hidx", F.sin(y).alias("s"), F.cos(y).alias("c"), F.sign(y - 25).cast("long").alias("g"),
        F.pow(F.lit(0.5), y / 10).alias("p"), clip(y, 5.0, 40.0).alias("k"), F.floor(y / 7).cast("double").alias("f"),
        F.bround(F.col("capacity") / 3, 4).alias("e"), F.abs(y - 30).alias("a"),
    )


@query(
    "F3_encodings", "panel_e",
    "SELECT unique_id, ds, sin(2 * pi() * hour(ds) / 24) AS hour_sin, cos(2 * pi() * hour(ds) / 24) AS hour_cos,"
    " sin(2 * pi() * (isodow(ds) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ds) - 1) / 7) AS dow_cos,"
    " CASE WHEN isodow(ds) >= 6 THEN 1e0 ELSE 0e0 END AS is_weekend FROM panel_e",
    digits="hour_sin hour_cos dow_sin dow_cos is_weekend",
)
def encodings(t: Tables):
    return t.panel_e.select("unique_id", "ds", *(x.alias(n) for n, x in calendar.periodic_encodings(F.col("ds")).items()))
