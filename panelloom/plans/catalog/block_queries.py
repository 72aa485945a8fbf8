"""Cross-series and per-series feature block queries, on the weekly panel with its signals imputed."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import blocks, impute, origin
from panelloom.operators.impute import MISSING
from panelloom.plans.registry import query
from panelloom.plans.tables import SIGNALS, Tables

CUT = 331


def each(template: str, sep: str = ", ", cols=SIGNALS) -> str:
    return sep.join(template.replace("@", c) for c in cols)


# Signals imputed by medians fitted before the cut, flags kept.
FULL = f"""
fm AS (SELECT unique_id, {each('median(@) AS m_@')} FROM panel_s WHERE hidx < {CUT} GROUP BY 1),
gm AS (SELECT {each('median(@) AS g_@')} FROM panel_s WHERE hidx < {CUT}),
full_s AS MATERIALIZED (SELECT unique_id, ds, hidx, y, {each('coalesce(@, m_@, g_@) AS @')}, {each('CAST(@ IS NULL AS DOUBLE) AS @_missing')},
  capacity, zone FROM panel_s JOIN fm USING (unique_id) CROSS JOIN gm)"""


def full(t: Tables):
    stats = impute.fit_fill_stats(t.kept_s.filter(F.col("hidx") < CUT), t.weekly)
    return impute.apply_fill(t.kept_s, t.weekly, stats)


def block(name: str, sql: str, cols: str, places=None, raw: bool = False):
    """Register a block query: keys and the block's own columns."""
    names = cols.split()

    def add(build):
        def run(t: Tables):
            df = t.kept_s if raw else full(t)
            out, made = build(t, df)
            if sorted(made) != sorted(names):
                raise ValueError(f"{name} made {made}")
            return out.select("unique_id", "hidx", *names)

        query(name, "panel_s", sql if raw else f"WITH {FULL.strip()}\n{sql}", digits=places or names)(run)
        return build

    return add


def sys_zone(prefix: str, cols) -> str:
    return "SELECT unique_id, hidx, " + ", ".join(
        f"avg({c}) OVER (PARTITION BY hidx) AS {prefix}_sys_{c}, avg({c}) OVER (PARTITION BY hidx, zone) AS {prefix}_zone_{c}" for c in cols
    )


@query(
    "X0_zone_labels", "panel_s",
    """WITH z AS (SELECT DISTINCT unique_id, round_even(sin(2 * pi() * zone / 5), 6) AS s, round_even(cos(2 * pi() * zone / 5), 6) AS c FROM panel_s)
    SELECT unique_id, dense_rank() OVER (ORDER BY s, c) - 1 AS zone FROM z""",
)
def zone_labels(t: Tables):
    import math

    angle = F.lit(2 * math.pi) * F.col("zone") / 5
    statics = t.panel_s.select("unique_id", F.sin(angle).alias("zone_sin"), F.cos(angle).alias("zone_cos")).distinct()
    return blocks.zone_labels(statics, t.weekly)


@block("X1_A1_system_zone_means", sys_zone("xs", SIGNALS) + " FROM full_s", " ".join(f"xs_sys_{c} xs_zone_{c}" for c in SIGNALS))
def a1(t, df):
    return blocks.system_zone_means(df, t.weekly, SIGNALS)


@block("X2_A2_refilled_means", sys_zone("xs2", ("x1", "capacity")) + " FROM full_s", "xs2_sys_x1 xs2_zone_x1 xs2_sys_capacity xs2_zone_capacity")
def a2(t, df):
    return blocks.system_zone_means_refilled(df, t.weekly, ["x1", "capacity"])


@block(
    "X3_A3_leave_one_out",
    f"SELECT a.unique_id, a.hidx, {each('avg(b.@) AS xs_loo_@', cols=('x1', 'x2'))} FROM full_s a JOIN full_s b"
    " ON a.hidx = b.hidx AND a.unique_id <> b.unique_id GROUP BY 1, 2",
    "xs_loo_x1 xs_loo_x2",
)
def a3(t, df):
    return blocks.leave_one_out(df, t.weekly, ["x1", "x2"])


@block(
    "X4_A4_shares_ranks",
    "SELECT a.unique_id, a.hidx, any_value(a.x1) / sum(b.x1) AS xs_share_x1,"
    " (count(*) FILTER (b.x1 < a.x1) + (count(*) FILTER (b.x1 = a.x1) + 1) / 2e0) / count(*) AS xs_rank_x1"
    " FROM full_s a JOIN full_s b ON a.hidx = b.hidx GROUP BY 1, 2",
    "xs_share_x1 xs_rank_x1",
)
def a4(t, df):
    return blocks.shares_and_ranks(df, t.weekly, ["x1"])


@block(
    "X5_A5_dispersion",
    "SELECT unique_id, hidx, xs_std_x1, xs_rng_x1, xs_std_y, xs_rng_y FROM full_s JOIN (SELECT hidx, stddev_samp(x1) AS xs_std_x1,"
    " quantile_cont(x1, 0.9) - quantile_cont(x1, 0.1) AS xs_rng_x1, stddev_samp(y) AS xs_std_y,"
    " quantile_cont(y, 0.9) - quantile_cont(y, 0.1) AS xs_rng_y FROM full_s GROUP BY 1) USING (hidx)",
    "xs_std_x1 xs_rng_x1 xs_std_y xs_rng_y",
)
def a5(t, df):
    return blocks.dispersion(df, t.weekly, ["x1", "y"])


@block(
    "X6_A6_missingness",
    "SELECT unique_id, hidx, avg(x1_missing) OVER w AS xs_miss_x1_missing, avg(x2_missing) OVER w AS xs_miss_x2_missing,"
    " avg(greatest(x1_missing, x2_missing)) OVER w AS xs_miss_any_frac FROM full_s WINDOW w AS (PARTITION BY hidx)",
    "xs_miss_x1_missing xs_miss_x2_missing xs_miss_any_frac",
)
def a6(t, df):
    return blocks.missingness(df, t.weekly, [f"x1{MISSING}", f"x2{MISSING}"])


@block(
    "X7_A7_rolling_system",
    ", s AS (SELECT hidx, avg(x1) AS m FROM full_s GROUP BY 1) SELECT f.unique_id, f.hidx,"
    " (SELECT avg(m) FROM s WHERE s.hidx BETWEEN f.hidx - 1 AND f.hidx + 1) AS xs_roll3_x1,"
    " (SELECT avg(m) FROM s WHERE s.hidx BETWEEN f.hidx - 12 AND f.hidx + 11) AS xs_roll24_x1 FROM full_s f",
    "xs_roll3_x1 xs_roll24_x1",
)
def a7(t, df):
    return blocks.rolling_system(df, t.chunked, ["x1"], (3, 24))


@block(
    "X9_A9_capacity_weighted",
    f"SELECT unique_id, hidx, {each('sum(@ * capacity) OVER w / sum(capacity) OVER w AS xs_cap_@')} FROM full_s WINDOW w AS (PARTITION BY hidx)",
    " ".join(f"xs_cap_{c}" for c in SIGNALS),
)
def a9(t, df):
    return blocks.capacity_weighted(df, t.weekly, SIGNALS)


@block(
    "X9_A9_null_propagation",
    "SELECT unique_id, hidx, xs_cap_x1 FROM panel_s JOIN (SELECT hidx, CASE WHEN count(x1) = count(*) THEN sum(x1 * capacity) / sum(capacity) END AS xs_cap_x1"
    " FROM panel_s GROUP BY 1) USING (hidx)",
    "xs_cap_x1",
    raw=True,
)
def a9_raw(t, df):
    return blocks.capacity_weighted(df, t.weekly, ["x1"])


@block(
    "X10_A10_system_target",
    ", s AS (SELECT hidx, avg(y) AS m FROM full_s GROUP BY 1) SELECT f.unique_id, f.hidx,"
    " (SELECT avg(m) FROM s WHERE s.hidx BETWEEN f.hidx - 29 AND f.hidx - 26) AS xs_ytgt4,"
    " (SELECT avg(m) FROM s WHERE s.hidx BETWEEN f.hidx - 38 AND f.hidx - 26) AS xs_ytgt13 FROM full_s f",
    "xs_ytgt4 xs_ytgt13",
)
def a10(t, df):
    return blocks.lagged_system_target(df, t.chunked, (4, 13))


@block(
    "X11_A11_leads_lags",
    ", s AS (SELECT hidx, avg(x1) AS m FROM full_s GROUP BY 1) SELECT f.unique_id, f.hidx, a.m AS xs_lead4_x1, b.m AS xs_lag4_x1, c.m AS xs_lag13_x1"
    " FROM full_s f LEFT JOIN s a ON a.hidx = f.hidx + 4 LEFT JOIN s b ON b.hidx = f.hidx - 4 LEFT JOIN s c ON c.hidx = f.hidx - 13",
    "xs_lead4_x1 xs_lag4_x1 xs_lag13_x1",
)
def a11(t, df):
    return blocks.system_leads_lags(df, t.chunked, ["x1"], (-4, 4, 13))


@query(
    "X8_A8_learned_partition", "panel_s",
    f"""WITH RECURSIVE {FULL.strip()},
    r AS MATERIALIZED (SELECT a.unique_id AS i, b.unique_id AS j, coalesce(corr(a.y, b.y), 0) AS r FROM panel_s a JOIN panel_s b ON a.hidx = b.hidx AND a.unique_id < b.unique_id
      WHERE a.hidx < {CUT} GROUP BY ALL),
    n AS MATERIALIZED (SELECT count(DISTINCT unique_id) AS n FROM panel_s),
    g AS (SELECT DISTINCT 0 AS step, unique_id, unique_id AS root FROM panel_s
      UNION ALL SELECT step + 1, unique_id, CASE WHEN root = two THEN one ELSE root END FROM g, n,
        (SELECT least(x.root, y.root) AS one, greatest(x.root, y.root) AS two FROM r JOIN g x ON x.unique_id = i JOIN g y ON y.unique_id = j
         WHERE x.root <> y.root GROUP BY ALL ORDER BY avg(r) DESC, one, two LIMIT 1)
      WHERE step < n - 8),
    c AS (SELECT unique_id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM g WHERE step = (SELECT max(step) FROM g))
    SELECT unique_id, hidx, cluster, avg(x1) OVER (PARTITION BY cluster, hidx) AS xs_clu_x1 FROM c JOIN full_s USING (unique_id)""",
    digits="xs_clu_x1",
)
def a8(t: Tables):
    df = full(t)
    groups = blocks.learned_groups(df, t.chunked, CUT, 8)
    out, (name,) = blocks.learned_partition(df, t.chunked, ["x1"], CUT, 8, groups)
    return out.select("unique_id", "hidx", name).join(groups, "unique_id").select("unique_id", "hidx", "cluster", name)


@query(
    "X12_A12_principal_components", "panel_s",
    "SELECT count(DISTINCT hidx) AS hours, TRUE AS same_for_all, TRUE AS in_order, TRUE AS orthogonal FROM panel_s",
)
def a12(t: Tables):
    out, names = blocks.principal_components(full(t), t.chunked, ["x1"], CUT, 3)
    hours = out.groupBy("hidx").agg(*(F.max(n).alias(n) for n in names), *(F.min(n).alias(f"_lo{i}") for i, n in enumerate(names)))
    a, b, c = (F.when(F.col("hidx") < CUT, F.col(n)) for n in names)
    size = lambda x: F.sum(x * x)
    apart = lambda x, y: F.abs(F.sum(x * y)) < 1e-6 * F.sqrt(size(x) * size(y))
    same = F.every(F.greatest(*(F.abs(F.col(n) - F.col(f"_lo{i}")) for i, n in enumerate(names))) < 1e-9)
    return hours.agg(
        F.count(F.lit(1)).alias("hours"), same.alias("same_for_all"), ((size(a) >= size(b)) & (size(b) >= size(c))).alias("in_order"),
        (apart(a, b) & apart(a, c) & apart(b, c)).alias("orthogonal"),
    )


@query(
    "X13_A13_channel_consensus", "panel_s",
    """WITH c AS (SELECT p.unique_id, p.hidx, p.zone, (SELECT h.y FROM panel_s h WHERE h.unique_id = p.unique_id
        AND h.hidx = greatest(331 - 26 * CAST(ceil((331 - p.hidx) / 26e0) AS BIGINT) - 13, 0)
          + (p.hidx - (331 - 26 * CAST(ceil((331 - p.hidx) / 26e0) AS BIGINT))) % 13) AS channel
      FROM panel_s p WHERE p.hidx < 331 AND 331 - 26 * CAST(ceil((331 - p.hidx) / 26e0) AS BIGINT) >= 13)
    SELECT a.unique_id, a.hidx, avg(b.channel) AS xs_sys_fc, avg(b.channel) FILTER (a.zone = b.zone) AS xs_zone_fc,
      (count(*) FILTER (b.channel < a.channel) + (count(*) FILTER (b.channel = a.channel) + 1) / 2e0) / count(*) AS xs_rank_fc
    FROM c a JOIN c b ON a.hidx = b.hidx GROUP BY 1, 2""",
    digits="xs_sys_fc xs_zone_fc xs_rank_fc",
)
def a13(t: Tables):
    rows, _ = origin.roll_train(t.panel_s, t.weekly, CUT, 26)
    rows = rows.filter(F.col("cutoff") >= 13).join(t.panel_s.select("unique_id", "hidx", "zone"), ["unique_id", "hidx"])
    out, names = blocks.channel_consensus(rows, t.weekly, "channel")
    return out.select("unique_id", "hidx", *names)


@query(
    "X14_A14_behaviour_statics", "panel_s",
    f"""WITH {FULL.strip()}, tr AS (SELECT f.*, a.y AS y1, b.y AS y4, c.y AS y13 FROM full_s f
      LEFT JOIN full_s a ON a.unique_id = f.unique_id AND a.hidx = f.hidx - 1
      LEFT JOIN full_s b ON b.unique_id = f.unique_id AND b.hidx = f.hidx - 4
      LEFT JOIN full_s c ON c.unique_id = f.unique_id AND c.hidx = f.hidx - 13 WHERE f.hidx < {CUT})
    SELECT unique_id, avg(y) AS xs_st_level, stddev_samp(y) AS xs_st_std, stddev_samp(y) / avg(y) AS xs_st_cv,
      (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / avg(y) AS xs_st_iqr, avg(abs(y - y1)) / avg(y) AS xs_st_d1,
      avg(abs(y - y13)) / avg(y) AS xs_st_d13, 1 - var_samp(y - y13) / var_samp(y) AS xs_st_seas13,
      1 - var_samp(y - y4) / var_samp(y) AS xs_st_seas4, avg(y) / any_value(capacity) AS xs_st_util,
      (avg(x1_missing) + avg(x2_missing) + avg(x3_missing)) / 3 AS xs_st_missrate FROM tr GROUP BY 1""",
    digits="xs_st_level xs_st_std xs_st_cv xs_st_iqr xs_st_d1 xs_st_d13 xs_st_seas13 xs_st_seas4 xs_st_util xs_st_missrate",
)
def a14(t: Tables):
    flags = [f"{c}{MISSING}" for c in SIGNALS]
    return blocks.history_statics(full(t), t.weekly, CUT, flags, day=4, week=13)[0]


@block(
    "X15_A15_hierarchical",
    ", s AS (SELECT hidx, avg(y) AS m FROM full_s GROUP BY 1), z AS (SELECT hidx, zone, avg(y) AS m FROM full_s GROUP BY 1, 2)"
    " SELECT f.unique_id, f.hidx, a.m AS xs_hier_sys, a.m - b.m AS xs_hier_drift, z.m AS xs_hier_zone FROM full_s f"
    " LEFT JOIN s a ON a.hidx = f.hidx - 26 LEFT JOIN s b ON b.hidx = f.hidx - 39 LEFT JOIN z ON z.hidx = f.hidx - 26 AND z.zone = f.zone",
    "xs_hier_sys xs_hier_drift xs_hier_zone",
)
def a15(t, df):
    return blocks.hierarchical_target(df, t.chunked, week=13)


def windows_sql(cols, widths) -> str:
    parts = [
        f"avg(b.{c}) FILTER (b.hidx BETWEEN a.hidx - {w // 2} AND a.hidx + {(w - 1) // 2}) AS cw{w}_{c}" for c in cols for w in widths
    ]
    far = max(widths) // 2
    return f"SELECT a.unique_id, a.hidx, {', '.join(parts)} FROM full_s a JOIN full_s b ON a.unique_id = b.unique_id AND b.hidx BETWEEN a.hidx - {far} AND a.hidx + {far} GROUP BY 1, 2"


@block("X16_B1_centred_windows", windows_sql(("x1", "x2"), (3, 6, 12, 24)), " ".join(f"cw{w}_{c}" for c in ("x1", "x2") for w in (3, 6, 12, 24)))
def b1(t, df):
    return blocks.centred_windows(df, t.chunked, ["x1", "x2"])


@block("X17_B2_all_signals_window", windows_sql(SIGNALS, (24,)), " ".join(f"cw24_{c}" for c in SIGNALS), places={"cw24_x1": 6, "cw24_x2": 6, "cw24_x3": 4})
def b2(t, df):
    return blocks.centred_windows(df, t.weekly, SIGNALS, (24,))


CAP = "(SELECT hidx, sum(x1 * capacity) / sum(capacity) AS xs_cap_x1 FROM full_s GROUP BY 1) cap"


@block("X18_B3_windows_and_capacity", f"SELECT * FROM ({windows_sql(('x1',), (3, 12))}) JOIN {CAP} USING (hidx)", "cw3_x1 cw12_x1 xs_cap_x1")
def b3(t, df):
    spec = t.weekly
    return blocks.compose(
        lambda d: blocks.centred_windows(d, spec, ["x1"], (3, 12)), lambda d: blocks.capacity_weighted(d, spec, ["x1"])
    )(df)


CLIM = (
    f", b AS (SELECT unique_id, hidx % 13 AS ph, avg(y) AS v FROM full_s WHERE hidx < {CUT} GROUP BY 1, 2),"
    f" l AS (SELECT unique_id, avg(y) AS lv FROM full_s WHERE hidx < {CUT} GROUP BY 1)"
)


@block("X19_C1_climatology", CLIM + " SELECT f.unique_id, f.hidx, v AS clim_how FROM full_s f JOIN b ON b.unique_id = f.unique_id AND b.ph = f.hidx % 13", "clim_how")
def c1(t, df):
    return blocks.climatology(df, t.weekly, CUT)


@block(
    "X20_C2_climatology_shape",
    CLIM + " SELECT f.unique_id, f.hidx, v AS clim_how, v / nullif(lv, 0) AS clim_how_shape FROM full_s f"
    " JOIN b ON b.unique_id = f.unique_id AND b.ph = f.hidx % 13 JOIN l ON l.unique_id = f.unique_id",
    "clim_how clim_how_shape",
)
def c2(t, df):
    return blocks.climatology(df, t.weekly, CUT, shape=True)


@block(
    "X21_C3_climatology_capacity",
    CLIM + f" SELECT f.unique_id, f.hidx, v AS clim_how, xs_cap_x1 FROM full_s f JOIN b ON b.unique_id = f.unique_id AND b.ph = f.hidx % 13 JOIN {CAP} USING (hidx)",
    "clim_how xs_cap_x1",
)
def c3(t, df):
    spec = t.weekly
    return blocks.compose(lambda d: blocks.climatology(d, spec, CUT), lambda d: blocks.capacity_weighted(d, spec, ["x1"]))(df)


@query(
    "X19_C1_unseen_phase", "panel_s",
    """WITH b AS (SELECT unique_id, hidx % 13 AS ph, avg(y) AS v FROM panel_s WHERE hidx < 9 GROUP BY 1, 2)
    SELECT p.unique_id, p.hidx, coalesce(b.v, (SELECT avg(v) FROM b m WHERE m.unique_id = p.unique_id)) AS clim_how
    FROM panel_s p LEFT JOIN b ON b.unique_id = p.unique_id AND b.ph = p.hidx % 13""",
    digits="clim_how",
)
def c1_unseen(t: Tables):
    return blocks.climatology(t.panel_s, t.weekly, 9)[0].select("unique_id", "hidx", "clim_how")


def ewma_sql(cols, halves) -> str:
    """Weighted sum over the whole past instead of a recursion."""
    parts = []
    for c in cols:
        for h in halves:
            a = f"(1 - pow(0.5, 1 / {h}e0))"
            parts.append(
                f"coalesce(sum(b.{c} * CASE WHEN b.hidx = 0 THEN 1 ELSE {a} END * pow(0.5, (a.hidx - 1 - b.hidx) / {h}e0)), any_value(a.{c})) AS ew_{c}_{h}"
            )
    return f"SELECT a.unique_id, a.hidx, {', '.join(parts)} FROM v a LEFT JOIN v b ON a.unique_id = b.unique_id AND b.hidx < a.hidx GROUP BY 1, 2"


EWV = (
    "WITH m AS (SELECT unique_id, median(x1) AS m1, median(x2) AS m2 FROM panel_s GROUP BY 1),"
    " v AS (SELECT unique_id, hidx, capacity, coalesce(x1, m1, (SELECT median(x1) FROM panel_s)) AS x1,"
    " coalesce(x2, m2, (SELECT median(x2) FROM panel_s)) AS x2 FROM panel_s JOIN m USING (unique_id)) "
)
CAPV = "(SELECT hidx, CASE WHEN count(x1) = count(*) THEN sum(x1 * capacity) / sum(capacity) END AS xs_cap_x1 FROM panel_s GROUP BY 1) cap"
EW4 = (6, 12, 24, 48)


@block("X22_EW_backward_memory", EWV + ewma_sql(("x1", "x2"), EW4), " ".join(f"ew_{c}_{h}" for c in ("x1", "x2") for h in EW4), raw=True)
def ew(t, df):
    return blocks.backward_memory(df, t.chunked, ["x1", "x2"], EW4)


@block("X23_EW2_short_memory", EWV + ewma_sql(("x1", "x2"), (6, 12)), "ew_x1_6 ew_x1_12 ew_x2_6 ew_x2_12", raw=True)
def ew2(t, df):
    return blocks.backward_memory(df, t.weekly, ["x1", "x2"], (6, 12))


@block("X24_EWA9_composition", EWV + f"SELECT * FROM ({ewma_sql(('x1',), EW4)}) JOIN {CAPV} USING (hidx)", "xs_cap_x1 " + " ".join(f"ew_x1_{h}" for h in EW4), raw=True)
def ewa9(t, df):
    made = blocks.registry(t.weekly, CUT, live=["x1"], given=["x1"], refill=[], memory=["x1"], asymmetric=["x1"])
    return made["EWA9"].build(df)


@block("X24_EW2A9_composition", EWV + f"SELECT * FROM ({ewma_sql(('x1',), (6, 12))}) JOIN {CAPV} USING (hidx)", "xs_cap_x1 ew_x1_6 ew_x1_12", raw=True)
def ew2a9(t, df):
    made = blocks.registry(t.weekly, CUT, live=["x1"], given=["x1"], refill=[], memory=["x1"], asymmetric=["x1"])
    return made["EW2A9"].build(df)


@query(
    "X25_attach_aggregates", "panel_s",
    f"WITH {FULL.strip()} SELECT unique_id, hidx, x1, avg(x1) OVER (PARTITION BY hidx, zone) AS xs_zone_x1 FROM full_s",
    digits="x1 xs_zone_x1",
)
def attach_active(t: Tables):
    made = blocks.registry(t.weekly, CUT, live=["x1"], given=["x1"], refill=[], memory=["x1"], asymmetric=["x1"])
    out = blocks.attach_aggregates(full(t), t.weekly, ["xs_zone_x1"], made)
    return out.select("unique_id", "hidx", "x1", "xs_zone_x1")


@query(
    "X26_own_region_weighted", "panel_s",
    """WITH w AS (SELECT unique_id, greatest(avg(y), 1e-6) AS w FROM panel_s WHERE hidx < 331 GROUP BY 1),
    e AS (SELECT ds, x3, w, CASE zone WHEN 0 THEN CAST(hidx % 2 AS DOUBLE) WHEN 1 THEN CAST(hidx % 3 = 0 AS DOUBLE)
          ELSE CAST(hidx % 5 = 0 AS DOUBLE) END AS own FROM panel_s JOIN w USING (unique_id))
    SELECT ds, sum(x3 * w) / sum(w) FILTER (x3 IS NOT NULL) AS xs_price_cap, sum(own * w) / sum(w) AS xs_snap_cap FROM e GROUP BY 1""",
    digits={"xs_price_cap": 4, "xs_snap_cap": 6},
)
def own_region(t: Tables):
    h = F.col("hidx")
    df = t.panel_s.withColumns(
        {"f0": (h % 2).cast("double"), "f1": (h % 3 == 0).cast("double"), "f2": (h % 5 == 0).cast("double"), "region": F.least("zone", F.lit(2))}
    )
    out, names = blocks.own_region_weighted(df, t.weekly, CUT, "x3", {0: "f0", 1: "f1", 2: "f2"}, "region")
    return out.select("ds", *names).groupBy("ds").agg(*(F.max(n).alias(n) for n in names))


@query(
    "X27_varying_columns", "panel_s",
    "WITH a AS (SELECT ds, max(x1) - min(x1) AS d1, max(hidx) - min(hidx) AS dh, max(capacity) - min(capacity) AS dc FROM panel_s GROUP BY 1)"
    " SELECT 'x1' AS col, count(*) FILTER (d1 > 0) AS n_varying, count(*) FILTER (d1 > 0) > 0 AS varies FROM a"
    " UNION ALL SELECT 'hidx', count(*) FILTER (dh > 0), count(*) FILTER (dh > 0) > 0 FROM a"
    " UNION ALL SELECT 'capacity', count(*) FILTER (dc > 0), count(*) FILTER (dc > 0) > 0 FROM a",
)
def varying(t: Tables):
    return blocks.varying_columns(t.panel_s, t.weekly, ["x1", "hidx", "capacity"])
