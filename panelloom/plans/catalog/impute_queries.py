"""Imputation and future-frame queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import baselines, calendar, impute, index, origin, provenance
from panelloom.plans.registry import query
from panelloom.plans.tables import SIGNALS, Tables

CUT, GAP_LEN = 552, 84
HOW = "((isodow(ds) - 1) * 24 + hour(ds))"


def each(template: str, sep: str = ", ", cols=SIGNALS) -> str:
    return sep.join(template.replace("@", c) for c in cols)


# History, gap rows and medians of the hourly panel, shared by the strategy oracles.
BASE = f"""
hist AS (SELECT *, {HOW} AS how FROM panel_e WHERE hidx < {CUT}),
gap AS (SELECT unique_id, ds, hidx, {HOW} AS how FROM panel_e WHERE hidx >= {CUT} AND hidx < {CUT + GAP_LEN}),
gmed AS (SELECT {each("median(@) AS g_@")} FROM hist),
med AS (SELECT unique_id, {each("coalesce(median(@), (SELECT g_@ FROM gmed)) AS m_@")} FROM hist GROUP BY 1),
bins AS (SELECT unique_id, how, count(*) AS n, {each("median(@) AS p_@")} FROM hist GROUP BY 1, 2),
hods AS (SELECT unique_id, hour(ds) AS hod, {each("median(@) AS p_@")} FROM hist GROUP BY 1, 2)"""

STRATEGY_SQL = {
    "median": f"SELECT unique_id, hidx, {each('m_@ AS @')} FROM gap JOIN med USING (unique_id)",
    "how168": f"SELECT unique_id, hidx, {each('coalesce(p_@, m_@) AS @')} FROM gap JOIN med USING (unique_id)"
    " LEFT JOIN bins USING (unique_id, how)",
    "hod24": f"SELECT gap.unique_id, hidx, {each('coalesce(p_@, m_@) AS @')} FROM gap JOIN med USING (unique_id)"
    " LEFT JOIN hods ON hods.unique_id = gap.unique_id AND hods.hod = hour(gap.ds)",
    "how168_lvl": f"""SELECT gap.unique_id, hidx, {each('coalesce(p_@, m_@) * least(greatest(coalesce(r_@ / nullif(b_@, 0), 1), 0.5), 2) AS @')}
      FROM gap JOIN med USING (unique_id) LEFT JOIN bins USING (unique_id, how)
      JOIN (SELECT unique_id, {each('avg(@) AS r_@')} FROM hist WHERE hidx >= {CUT - 168} GROUP BY 1) r USING (unique_id)
      JOIN (SELECT h.unique_id, {each('avg(coalesce(b.p_@, m.m_@)) AS b_@')} FROM hist h JOIN med m USING (unique_id)
            LEFT JOIN bins b ON b.unique_id = h.unique_id AND b.how = h.how GROUP BY 1) b USING (unique_id)""",
    "ffill_decay": f"""SELECT gap.unique_id, hidx, {each('m_@ + coalesce((l_@ - m_@) * pow(0.5, (hidx - seen) / 48e0), 0) AS @')}
      FROM gap JOIN med USING (unique_id)
      JOIN (SELECT unique_id, max(hidx) FILTER ({each('@ IS NOT NULL', ' OR ')}) AS seen, {each('arg_max(@, hidx) FILTER (@ IS NOT NULL) AS l_@')}
            FROM hist GROUP BY 1) l USING (unique_id)""",
    "snaive168": f"""SELECT g.unique_id, g.hidx, {each('coalesce(h.@, m_@) AS @')} FROM
      (SELECT gap.*, hidx - 168 * greatest((hidx - seen) // 168 + 1, 1) AS src FROM gap
       JOIN (SELECT unique_id, max(hidx) AS seen FROM hist WHERE {each('@ IS NOT NULL', ' OR ')} GROUP BY 1) USING (unique_id)) g
      JOIN med USING (unique_id) LEFT JOIN hist h ON h.unique_id = g.unique_id AND h.hidx = g.src""",
}


def gap_frames(t: Tables):
    history = t.panel_e.filter(F.col("hidx") < CUT)
    return index.gapped_horizon(t.panel_e, t.hourly, CUT, GAP_LEN), history


def gap_fill(t: Tables, strategy: str):
    block, history = gap_frames(t)
    out = impute.reconstruct_block(block, history, t.hourly, SIGNALS, F.lit(True), strategy=strategy)
    return out.select("unique_id", "hidx", *SIGNALS)


for _id, _name in {
    "I3_gap_median": "median", "I4_hour_of_week": "how168", "I5_hour_of_day": "hod24", "I6_leveled_profile": "how168_lvl",
    "I7_decay_to_median": "ffill_decay", "I8_last_week": "snaive168",
}.items():
    query(_id, "panel_e", f"WITH {BASE.strip()}\n{STRATEGY_SQL[_name]}", digits=SIGNALS)(lambda t, s=_name: gap_fill(t, s))


@query(
    "I12_strategy_arms", "panel_e",
    f"WITH {BASE.strip()}\n"
    + " UNION ALL ".join(
        f"SELECT '{s}' AS strategy, {each('avg(@) AS @')} FROM ({q})" for s, q in STRATEGY_SQL.items()
    ),
    digits=SIGNALS,
)
def strategy_arms(t: Tables):
    arms = [s for s in impute.available(impute.GAP) if s != "frame"]
    parts = [gap_fill(t, s).agg(*(F.avg(c).alias(c) for c in SIGNALS)).withColumn("strategy", F.lit(s)) for s in arms]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "I1_fill_stats", "panel_s",
    " UNION ALL ".join(
        f"SELECT '{c}' AS col, unique_id, median({c}) AS median FROM panel_s GROUP BY 2 UNION ALL SELECT '{c}', NULL, median({c}) FROM panel_s"
        for c in SIGNALS
    ),
    digits="median",
)
def fill_stats(t: Tables):
    return impute.fit_fill_stats(t.kept_s, t.weekly).long()


@query(
    "I2_apply_fill", "panel_s",
    f"WITH m AS (SELECT unique_id, {each('median(@) AS m_@')} FROM panel_s WHERE hidx < 331 GROUP BY 1)"
    f" SELECT unique_id, hidx, {each('coalesce(@, m_@, (SELECT median(@) FROM panel_s WHERE hidx < 331)) AS @')},"
    f" {each('CAST(@ IS NULL AS DOUBLE) AS @_missing')} FROM panel_s JOIN m USING (unique_id)",
    digits=SIGNALS,
)
def apply_fill(t: Tables):
    stats = impute.fit_fill_stats(t.kept_s.filter("hidx < 331"), t.weekly)
    out = impute.apply_fill(t.kept_s, t.weekly, stats)
    return out.select("unique_id", "hidx", *SIGNALS, *(f"{c}{impute.MISSING}" for c in SIGNALS))


NEIGHBOURS = f"""
ends AS (SELECT p.unique_id, p.hidx, p.x1, p.x2, p.x3,
  (SELECT max(q.hidx) FROM panel_s q WHERE q.unique_id = p.unique_id AND q.hidx <= p.hidx AND q.x1 IS NOT NULL) AS a,
  (SELECT min(q.hidx) FROM panel_s q WHERE q.unique_id = p.unique_id AND q.hidx >= p.hidx AND q.x1 IS NOT NULL) AS b FROM panel_s p),
meds AS (SELECT unique_id, {each('median(@) AS m_@')} FROM panel_s GROUP BY 1)"""


@query(
    "I9_interpolate_scattered", "panel_s",
    f"""WITH {NEIGHBOURS.strip()}
    SELECT e.unique_id, e.hidx, {each('coalesce(e.@, l.@ + (r.@ - l.@) * (e.hidx - a) / (b - a), m_@) AS @')}
    FROM ends e LEFT JOIN panel_s l ON l.unique_id = e.unique_id AND l.hidx = a
    LEFT JOIN panel_s r ON r.unique_id = e.unique_id AND r.hidx = b JOIN meds ON meds.unique_id = e.unique_id""",
    digits={"x1": 6, "x2": 6, "x3": 4},
)
def interpolate(t: Tables):
    stats = impute.fit_fill_stats(t.kept_s, t.weekly)
    out = impute.apply_fill(t.kept_s, t.chunked, stats, SIGNALS, strategy="interp", add_flags=False)
    return out.select("unique_id", "hidx", *SIGNALS)


@query(
    "I10_carry_scattered", "panel_s",
    f"""WITH {NEIGHBOURS.strip()}
    SELECT e.unique_id, e.hidx, {each('coalesce(e.@, l.@, m_@) AS @')} FROM ends e
    LEFT JOIN panel_s l ON l.unique_id = e.unique_id AND l.hidx = a JOIN meds ON meds.unique_id = e.unique_id""",
    digits=SIGNALS,
)
def carry(t: Tables):
    stats = impute.fit_fill_stats(t.kept_s, t.weekly)
    out = impute.apply_fill(t.kept_s, t.chunked, stats, SIGNALS, strategy="ffill", add_flags=False)
    return out.select("unique_id", "hidx", *SIGNALS)


@query(
    "I11_frame_backed", "panel_e",
    f"""WITH {BASE.strip()}
    SELECT g.unique_id, g.hidx, coalesce(f.x1, p_x1, m_x1) AS x1, coalesce(p_x2, m_x2) AS x2, coalesce(p_x3, m_x3) AS x3
    FROM gap g JOIN med USING (unique_id) LEFT JOIN bins USING (unique_id, how)
    LEFT JOIN hist f ON f.unique_id = g.unique_id AND f.hidx = g.hidx - 168 AND g.hidx < {CUT + 60}""",
    digits=SIGNALS,
)
def frame_backed(t: Tables):
    block, history = gap_frames(t)
    spec = t.hourly
    # The frame repeats the last week of x1 and covers part of the gap; its provenance must be honest here.
    source = t.panel_e.select("unique_id", "hidx", F.col("x1").alias("y"))
    window = origin.horizon_window(t.panel_e.select("unique_id", "ds", "hidx"), spec, CUT, 60)
    frame = baselines.seasonal_naive(window, source.filter(F.col("hidx") < CUT), spec, 168, "x1").select("unique_id", "ds", "x1")
    prov = provenance.table(t.spark, "x1", [(CUT, 60)], spec.series_len)
    provenance.check_honest(prov, "x1", CUT, GAP_LEN)
    out = impute.reconstruct_block(block, history, spec, SIGNALS, F.lit(True), strategy="frame", frame=frame)
    return out.select("unique_id", "hidx", *SIGNALS)


# A column that is an exact weekly function, and one that is almost always zero.
ODD = f"SELECT *, length(unique_id) + 0.5 * {HOW} AS w, CASE WHEN hidx % 11 = 0 THEN y ELSE 0 END AS s FROM panel_e"


def odd_panel(t: Tables):
    from panelloom.functions.exprs import hour_of_week

    return t.panel_e.withColumns(
        {
            "w": F.length("unique_id") + F.lit(0.5) * hour_of_week(F.col("ds")),
            "s": F.when(F.col("hidx") % 11 == 0, F.col("y")).otherwise(F.lit(0.0)),
        }
    )


@query(
    "I13_exact_columns", "panel_e",
    f"WITH o AS ({ODD}), b AS (SELECT unique_id, {HOW} AS how, count(*) AS n, count(DISTINCT w) AS dw, count(w) AS nw, count(DISTINCT x1) AS d1, count(x1) AS n1"
    f" FROM o WHERE hidx < {CUT} GROUP BY 1, 2)"
    " SELECT 'w' AS col, max(dw) = 1 AND min(n) >= 3 AND min(nw - n) = 0 AS exact FROM b UNION ALL"
    " SELECT 'x1', max(d1) = 1 AND min(n) >= 3 AND min(n1 - n) = 0 FROM b",
)
def exact_columns(t: Tables):
    return impute.exact_report(odd_panel(t).filter(F.col("hidx") < CUT), t.hourly, ["w", "x1"])


@query(
    "I14_sparse_columns", "panel_e",
    f"WITH o AS ({ODD}), m AS (SELECT unique_id, median(s) AS ms, median(x1) AS m1 FROM o WHERE hidx < {CUT} GROUP BY 1)"
    " SELECT 's' AS col, bool_and(ms = 0) AS sparse FROM m UNION ALL SELECT 'x1', bool_and(coalesce(m1 = 0, false)) FROM m",
)
def sparse_columns(t: Tables):
    return impute.sparse_report(odd_panel(t).filter(F.col("hidx") < CUT), t.hourly, ["s", "x1"])


@query(
    "I15_reconstruct_block", "panel_e",
    f"""WITH o AS ({ODD}), hist AS (SELECT *, {HOW} AS how FROM o WHERE hidx < {CUT}),
    med AS (SELECT unique_id, median(x1) AS m1, median(s) AS ms FROM hist GROUP BY 1),
    bins AS (SELECT unique_id, how, median(x1) AS p1, any_value(w) AS w FROM hist GROUP BY 1, 2)
    SELECT o.unique_id, o.hidx, CASE WHEN masked THEN coalesce(p1, m1, (SELECT median(x1) FROM hist)) ELSE o.x1 END AS x1,
      CASE WHEN masked THEN ms ELSE o.s END AS s, CASE WHEN masked THEN coalesce(b.w, (SELECT median(w) FROM hist)) ELSE o.w END AS w
    FROM (SELECT *, {HOW} AS how, hidx < {CUT + GAP_LEN} AS masked FROM o WHERE hidx >= {CUT} AND hidx < {CUT + 2 * GAP_LEN}) o
    JOIN med USING (unique_id) LEFT JOIN bins b USING (unique_id, how)""",
    digits="x1 s w",
)
def reconstruct(t: Tables):
    panel = odd_panel(t)
    history = panel.filter(F.col("hidx") < CUT)
    block = index.gapped_horizon(panel, t.hourly, CUT)
    mask = F.col("hidx") < CUT + GAP_LEN
    out = impute.reconstruct_block(block, history, t.hourly, ["x1", "s", "w"], mask, strategy="how168+guard+exact")
    return out.select("unique_id", "hidx", "x1", "s", "w")


@query(
    "I16_fill_scattered", "panel_e",
    f"""WITH b AS (SELECT unique_id, {HOW} AS how, {each('median(@) AS p_@')} FROM panel_e GROUP BY 1, 2),
    m AS (SELECT unique_id, {each('median(@) AS m_@')} FROM panel_e GROUP BY 1)
    SELECT p.unique_id, p.hidx, {each('coalesce(p.@, p_@, m_@, (SELECT median(@) FROM panel_e)) AS @')}
    FROM (SELECT *, {HOW} AS how FROM panel_e) p JOIN b USING (unique_id, how) JOIN m USING (unique_id)""",
    digits=SIGNALS,
)
def scattered(t: Tables):
    out = impute.fill_scattered(t.panel_e, t.hourly, SIGNALS, strategy="how168")
    return out.select("unique_id", "hidx", *SIGNALS)


@query(
    "I17_horizon_plan", "panel_e",
    f"SELECT CAST(60 AS BIGINT) AS gap, count(DISTINCT ds) AS span, 60 + count(DISTINCT ds) AS h_required, min(ds) AS first_forecast, max(ds) AS last_forecast"
    f" FROM panel_e WHERE hidx >= {CUT + 60}",
)
def horizon_plan(t: Tables):
    return impute.horizon_plan(t.panel_e.filter(F.col("hidx") < CUT), t.panel_e.filter(F.col("hidx") >= CUT + 60), t.hourly)


def encoded(t: Tables):
    """The hourly panel with calendar columns supplied for three rows in four."""
    supplied = F.pmod(F.col("hidx"), F.lit(4)) != 0
    enc = calendar.periodic_encodings(F.col("ds"))
    trend = F.lit(1.25) + F.lit(0.0007) * F.col("hidx")
    return t.panel_e.withColumns({n: F.when(supplied, x) for n, x in {**enc, "trend": trend}.items()})


ENCODINGS_SQL = {
    "hour_sin": "sin(2 * pi() * hour(ds) / 24)", "hour_cos": "cos(2 * pi() * hour(ds) / 24)",
    "dow_sin": "sin(2 * pi() * (isodow(ds) - 1) / 7)", "dow_cos": "cos(2 * pi() * (isodow(ds) - 1) / 7)",
    "is_weekend": "CASE WHEN isodow(ds) >= 6 THEN 1e0 ELSE 0e0 END",
}


@query(
    "I18_complete_periodic", "panel_e",
    "SELECT unique_id, hidx, " + ", ".join(f"{x} AS {n}" for n, x in ENCODINGS_SQL.items()) + " FROM panel_e",
    digits=tuple(ENCODINGS_SQL),
)
def complete_periodic(t: Tables):
    return calendar.complete_periodic(encoded(t), "ds").select("unique_id", "hidx", *ENCODINGS_SQL)


@query("I19_complete_trend", "panel_e", "SELECT unique_id, hidx, 1.25 + 0.0007 * hidx AS trend FROM panel_e", digits="trend")
def complete_trend(t: Tables):
    return calendar.complete_trend(encoded(t), "ds").select("unique_id", "hidx", "trend")


@query(
    "I20_build_future", "panel_e",
    f"""WITH cov AS (SELECT * FROM panel_e WHERE hidx >= {CUT + GAP_LEN}),
    cm AS (SELECT unique_id, {each('median(@) AS c_@')} FROM cov GROUP BY 1),
    hm AS (SELECT unique_id, {each('median(@) AS m_@')} FROM panel_e WHERE hidx < {CUT} GROUP BY 1)
    SELECT p.unique_id, p.ds, {', '.join(f'{x} AS {n}' for n, x in ENCODINGS_SQL.items())}, 1.25 + 0.0007 * hidx AS trend,
      {each(f'CASE WHEN hidx < {CUT + GAP_LEN} THEN coalesce(c_@, (SELECT median(@) FROM cov)) ELSE coalesce(@, m_@, (SELECT median(@) FROM panel_e WHERE hidx < {CUT})) END AS @')},
      {each(f'CASE WHEN hidx < {CUT + GAP_LEN} OR @ IS NULL THEN 1e0 ELSE 0e0 END AS @_missing')}
    FROM panel_e p JOIN cm USING (unique_id) JOIN hm USING (unique_id) WHERE hidx >= {CUT} AND hidx < {CUT + 2 * GAP_LEN}""",
    digits=(*ENCODINGS_SQL, "trend", *SIGNALS),
)
def build_future(t: Tables):
    stats = impute.fit_fill_stats(t.panel_e.filter(F.col("hidx") < CUT), t.hourly)
    enc = calendar.periodic_encodings(F.col("ds"))
    cov = t.panel_e.filter(F.col("hidx") >= CUT + GAP_LEN).withColumns(
        {**enc, "trend": F.lit(1.25) + F.lit(0.0007) * F.col("hidx")}
    )
    cov = cov.select("unique_id", "ds", *enc, "trend", *SIGNALS)
    wanted = index.gapped_horizon(t.panel_e, t.hourly, CUT).select("unique_id", "ds")
    return impute.build_future(cov, wanted, t.hourly, stats)


@query(
    "I21_withhold_gap", "panel_e",
    f"""WITH {BASE.strip()}
    SELECT p.unique_id, p.hidx, {each(f'CASE WHEN hidx < {CUT + GAP_LEN} THEN m_@ ELSE @ END AS @')},
      {each(f'CASE WHEN hidx < {CUT + GAP_LEN} OR @ IS NULL THEN 1e0 ELSE 0e0 END AS @_missing')}
    FROM panel_e p JOIN med USING (unique_id) WHERE hidx >= {CUT} AND hidx < {CUT + 2 * GAP_LEN}""",
    digits=SIGNALS,
)
def withhold(t: Tables):
    flagged = impute.add_indicators(t.panel_e, SIGNALS)
    future = index.gapped_horizon(flagged, t.hourly, CUT)
    out = impute.withhold_gap(future, flagged.filter(F.col("hidx") < CUT), t.hourly, GAP_LEN, SIGNALS)
    return out.select("unique_id", "hidx", *SIGNALS, *(f"{c}_missing" for c in SIGNALS))


@query(
    "I22_future_grid", "panel_e",
    "WITH l AS (SELECT unique_id, max(ds) AS last FROM panel_e WHERE x1 IS NOT NULL GROUP BY 1)"
    " SELECT unique_id, CAST(i AS BIGINT) AS step, last + to_hours(CAST(i AS INTEGER)) AS ds FROM l, range(1, 49) r(i)",
)
def future_grid(t: Tables):
    return impute.future_grid(t.panel_e.filter("x1 IS NOT NULL"), t.hourly, 48)


@query(
    "I23_attach_channel", "panel_s",
    """WITH ch AS (SELECT unique_id, hidx, CASE WHEN hidx >= 39 AND zone <> 4 THEN y + 1 END AS c FROM panel_s)
    SELECT p.unique_id, p.hidx, CAST(c IS NULL AS DOUBLE) AS channel_missing,
      coalesce(c, median(c) OVER (PARTITION BY p.unique_id), 0) AS channel FROM panel_s p JOIN ch USING (unique_id, hidx)""",
    digits="channel",
)
def attach_channel(t: Tables):
    channel = t.panel_s.filter("hidx >= 39 AND zone <> 4").select("unique_id", "ds", (F.col("y") + 1).alias("channel"))
    out = impute.attach_channel(t.panel_s, channel, t.weekly, "channel")
    return out.select("unique_id", "hidx", "channel", "channel_missing")


@query(
    "I23_degraded_channel", "panel_s",
    """WITH m AS (SELECT unique_id, median(CASE WHEN zone <> 4 THEN y END) AS m FROM panel_s GROUP BY 1)
    SELECT unique_id, hidx, coalesce(m, (SELECT median(m) FROM m)) AS channel, 1e0 AS channel_missing
    FROM panel_s JOIN m USING (unique_id) WHERE hidx >= 331""",
    digits="channel",
)
def degraded_channel(t: Tables):
    rows = t.panel_s.withColumn("channel", F.when(F.col("zone") != 4, F.col("y")))
    stats = impute.fit_fill_stats(rows, t.weekly, ["channel"])
    out = impute.degraded_channel(t.panel_s.filter("hidx >= 331"), stats, t.weekly, "channel")
    return out.select("unique_id", "hidx", "channel", "channel_missing")


@query(
    "I24_robust_scale", "panel_s",
    """WITH m AS (SELECT unique_id, median(y) AS my, median(x1) AS m1 FROM panel_s GROUP BY 1),
    s AS (SELECT unique_id, median(abs(y - my)) AS sy, median(abs(x1 - m1)) AS s1 FROM panel_s JOIN m USING (unique_id) GROUP BY 1)
    SELECT unique_id, hidx, (y - my) / CASE WHEN sy > 0 THEN sy ELSE 1 END AS y, (x1 - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1 END AS x1,
      y AS y_back FROM panel_s JOIN m USING (unique_id) JOIN s USING (unique_id)""",
    digits="y x1 y_back",
)
def robust(t: Tables):
    cols = ["y", "x1"]
    rows = t.panel_s.select("unique_id", "hidx", *cols)
    table = impute.robust_scale_table(rows, t.weekly, cols)
    scaled = impute.robust_scale(rows, table, t.weekly, cols)
    back = impute.robust_scale(scaled, table, t.weekly, cols, inverse=True).select("unique_id", "hidx", F.col("y").alias("y_back"))
    return scaled.join(back, ["unique_id", "hidx"])


@query(
    "I25_carry_both_ways", "panel_s",
    """WITH v AS (SELECT unique_id, hidx, CASE WHEN zone <> 1 THEN x1 END AS x1 FROM panel_s),
    w AS (SELECT *, last_value(x1 IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY hidx) AS f FROM v)
    SELECT unique_id, hidx, coalesce(f, first_value(f IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY hidx
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS x1 FROM w""",
    digits="x1",
)
def both_ways(t: Tables):
    rows = t.panel_s.select("unique_id", "hidx", F.when(F.col("zone") != 1, F.col("x1")).alias("x1"))
    return impute.carry_both_ways(rows, t.chunked, ["x1"])


SHARED = "SELECT unique_id, hidx, ds, x1, CASE WHEN (hidx + zone) % 3 <> 0 THEN 0.5 * hidx END AS z FROM panel_s"


def shared_panel(t: Tables):
    z = F.when((F.col("hidx") + F.col("zone")) % 3 != 0, F.lit(0.5) * F.col("hidx"))
    return t.panel_s.select("unique_id", "hidx", "ds", "x1", z.alias("z"))


@query(
    "I26_shared_columns", "panel_s",
    f"WITH s AS ({SHARED}), a AS (SELECT ds, max(x1) - min(x1) AS d1, max(z) - min(z) AS dz FROM s GROUP BY 1)"
    " SELECT 'x1' AS col, max(d1) AS max_spread, max(d1) = 0 AS shared FROM a UNION ALL SELECT 'z', max(dz), max(dz) = 0 FROM a",
    digits="max_spread",
)
def shared_columns(t: Tables):
    return impute.shared_report(shared_panel(t), t.weekly, ["x1", "z"])


@query("I26_recover_shared", "panel_s", "SELECT unique_id, hidx, 0.5 * hidx AS z FROM panel_s", digits="z")
def recover_shared(t: Tables):
    return impute.recover_shared(shared_panel(t), t.weekly, ["x1", "z"]).select("unique_id", "hidx", "z")


@query(
    "I27_backtest_gap", "panel_e",
    f"""WITH {BASE.strip()},
    arms AS ({' UNION ALL '.join(f"SELECT '{s}' AS strategy, * FROM ({STRATEGY_SQL[s]})" for s in ('median', 'how168', 'hod24', 'snaive168'))}),
    e AS (SELECT strategy, {each("sum(abs(p.@ - a.@)) AS e_@, sum(abs(p.@)) AS a_@, count(p.@) AS n_@")} FROM arms a JOIN panel_e p USING (unique_id, hidx) GROUP BY 1),
    l AS ({each("SELECT strategy, '@' AS col, e_@ / a_@ AS wape, n_@ AS n_cells FROM e", ' UNION ALL ')})
    SELECT l.col, l.strategy, l.n_cells, l.wape, 1 - l.wape / m.wape AS gain FROM l JOIN l m ON m.col = l.col AND m.strategy = 'median'""",
    digits="wape gain",
)
def backtest_gap(t: Tables):
    return impute.backtest_gap(t.panel_e, t.hourly, SIGNALS, CUT, GAP_LEN, ["how168", "hod24", "snaive168"])


@query(
    "I27_backtest_scattered", "panel_e",
    f"""WITH src AS (SELECT *, hidx % 7 = 3 AS hide, {HOW} AS how FROM panel_e),
    v AS (SELECT unique_id, hidx, how, hide, {each('CASE WHEN NOT hide THEN @ END AS @, CASE WHEN hide THEN @ END AS t_@')} FROM src),
    m AS (SELECT unique_id, {each('median(@) AS m_@')} FROM v GROUP BY 1),
    b AS (SELECT unique_id, how, {each('median(@) AS p_@')} FROM v GROUP BY 1, 2),
    c AS (SELECT unique_id, hidx, {each('last_value(@ IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY hidx) AS c_@')} FROM v),
    e AS (SELECT 'median' AS strategy, {each('sum(abs(t_@ - m_@)) AS e_@, sum(abs(t_@)) AS a_@, count(t_@) AS n_@')} FROM v JOIN m USING (unique_id)
      UNION ALL SELECT 'how168', {each('sum(abs(t_@ - coalesce(p_@, m_@))), sum(abs(t_@)), count(t_@)')} FROM v JOIN m USING (unique_id) JOIN b USING (unique_id, how)
      UNION ALL SELECT 'ffill', {each('sum(abs(t_@ - coalesce(c_@, m_@))), sum(abs(t_@)), count(t_@)')} FROM v JOIN m USING (unique_id) JOIN c USING (unique_id, hidx)),
    l AS ({each("SELECT strategy, '@' AS col, e_@ / a_@ AS wape, n_@ AS n_cells FROM e", ' UNION ALL ')})
    SELECT l.col, l.strategy, l.n_cells, l.wape, 1 - l.wape / m.wape AS gain FROM l JOIN l m ON m.col = l.col AND m.strategy = 'median'""",
    digits="wape gain",
)
def backtest_scattered(t: Tables):
    hide = F.pmod(F.col("hidx"), F.lit(7)) == 3
    return impute.backtest_scattered(t.panel_e, t.hourly, SIGNALS, hide, ["how168", "ffill"])
