"""Evaluation, blending, provenance and diagnosis queries on the prediction cube."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions import metrics as M
from panelloom.operators import blend, diagnose, evaluate, index, origin, provenance
from panelloom.operators.aggregates import static_frame
from panelloom.plans.registry import query
from panelloom.plans.tables import CUTOFFS, MEMBERS, Tables

SN, SM = "seasonal_naive", "seasonal_mean"
LONG = "UNPIVOT ({}) ON naive, seasonal_naive, seasonal_mean INTO NAME member VALUE p"

# ---------------------------------------------------------------- E: evaluation


@query(
    "E1_validation_report", "cube",
    """WITH d AS (SELECT cutoff, unique_id, ds, y, CASE WHEN zero THEN NULL ELSE seasonal_mean END AS p FROM (SELECT *, y = 0 AS zero FROM scored)
      UNION ALL SELECT cutoff, unique_id, ds, y, seasonal_mean FROM scored WHERE blk = 0 AND cutoff = 318)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(ny) AS BIGINT) AS null_target, CAST(sum(np) AS BIGINT) AS null_member,
      CAST(sum(n - k) AS BIGINT) AS duplicates, min(n) AS min_rows, max(n) AS max_rows FROM
     (SELECT cutoff, unique_id, count(*) AS n, count(DISTINCT ds) AS k, count(*) - count(y) AS ny, count(*) - count(p) AS np FROM d GROUP BY 1, 2)""",
)
def validation(t: Tables):
    rows = t.scored.select("cutoff", "unique_id", "ds", "y", F.when(F.col("y") != 0, F.col(SM)).alias("p"))
    again = t.scored.filter("blk = 0 AND cutoff = 318").select("cutoff", "unique_id", "ds", "y", F.col(SM).alias("p"))
    return evaluate.validation_report(rows.unionByName(again), t.weekly, "p")


@query(
    "E2_error_correlation", "cube",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a} - y, {b} - y) AS corr FROM scored"
        for a, b in (("naive", SN), ("naive", SM), (SN, SM))
    ),
    digits="corr",
)
def error_correlation(t: Tables):
    return evaluate.error_correlation(t.scored, t.weekly, MEMBERS)


@query(
    "E3_windows_won", "cube",
    f"""SELECT cutoff, sum(abs(y - {SM})) / sum(abs(y)) AS candidate, sum(abs(y - {SN})) / sum(abs(y)) AS baseline,
      sum(abs(y - {SN})) / sum(abs(y)) - sum(abs(y - {SM})) / sum(abs(y)) AS delta, sum(abs(y - {SN})) > sum(abs(y - {SM})) AS won
    FROM scored GROUP BY 1""",
    digits="candidate baseline delta",
)
def windows_won(t: Tables):
    return evaluate.windows_won(t.scored, t.weekly, SM, SN)


N_BOOT = 4_000

BOOT = f"""
blocks AS (SELECT cutoff, unique_id, sum(abs(y)) AS ya, sum(abs(y - {SM})) AS ae_c, sum(abs(y - {SN})) AS ae_b FROM scored GROUP BY 1, 2),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY substr(md5(cutoff || ':' || unique_id), 1, 3), cutoff, unique_id) - 1 AS pos,
  count(*) OVER () AS n FROM blocks),
draws AS (SELECT r.rep, CAST('0x' || substr(md5('0:' || r.rep || ':' || b.pos), 1, 8) AS BIGINT) % b.n AS pos
          FROM numbered b, (SELECT unnest(range({N_BOOT})) AS rep) r),
reps AS MATERIALIZED (SELECT rep, sum(ae_b) / sum(ya) - sum(ae_c) / sum(ya) AS delta FROM draws JOIN numbered USING (pos) GROUP BY 1)"""


@query("E4_bootstrap_draws", "cube", f"WITH {BOOT.strip()} SELECT CAST(rep AS BIGINT) AS rep, delta FROM reps", digits="delta")
def bootstrap_draws(t: Tables):
    return evaluate.bootstrap_draws(t.stored_scored, t.weekly, SM, SN, n_boot=N_BOOT)


OBSERVED = f"(SELECT sum(abs(y - {SN})) / sum(abs(y)) - sum(abs(y - {SM})) / sum(abs(y)) FROM scored)"


@query(
    "E4_paired_bootstrap", "cube",
    f"""WITH {BOOT.strip()} SELECT '{SM}' AS candidate, '{SN}' AS baseline, {OBSERVED} AS delta, stddev_samp(delta) AS se,
      quantile_cont(delta, 0.025) AS ci_low, quantile_cont(delta, 0.975) AS ci_high, {OBSERVED} / stddev_samp(delta) AS delta_in_se,
      (SELECT count(*) FROM blocks) AS n_blocks, CAST({N_BOOT} AS BIGINT) AS n_boot FROM reps""",
    digits={"delta": 6, "se": 6, "ci_low": 6, "ci_high": 6, "delta_in_se": 4},
)
def paired_bootstrap(t: Tables):
    return evaluate.paired_bootstrap(t.stored_scored, t.weekly, SM, SN, n_boot=N_BOOT)


@query(
    "E5_admission", "cube",
    f"""WITH w AS (SELECT cutoff, sum(abs(y - {SM})) AS c, sum(abs(y - {SN})) AS b, sum(abs(y)) AS a FROM scored WHERE blk >= 9 GROUP BY 1),
    r AS (SELECT sum(c) / sum(a) AS candidate_wape, sum(b) / sum(a) AS baseline_wape, count(*) AS windows_total,
      count(*) FILTER (b > c) AS windows_won, stddev_samp((b - c) / a) AS delta_spread, stddev_pop(b / a) AS baseline_sigma FROM w),
    k AS (SELECT greatest(corr({SM} - y, {SN} - y), corr({SM} - y, naive - y)) AS e FROM scored WHERE blk >= 9)
    SELECT r.*, baseline_wape - candidate_wape AS margin, CAST(2 AS BIGINT) AS windows_required, k.e AS max_err_corr,
      baseline_wape > candidate_wape AS pooled_improves, windows_won >= 2 AS majority_improves, k.e < 0.95 AS orthogonal FROM r, k""",
    digits="candidate_wape baseline_wape delta_spread baseline_sigma margin max_err_corr",
)
def admission(t: Tables):
    return evaluate.evaluate_admission(t.stored_scored, t.weekly, SM, SN, "late", incumbents=["naive", SN])


@query(
    "E6_final_bar", "cube",
    f"""WITH {BOOT.strip()}, c AS (SELECT quantile_cont(delta, 0.025) AS ci_low, quantile_cont(delta, 0.975) AS ci_high FROM reps),
    w AS (SELECT bool_and(b > c) AS won FROM (SELECT cutoff, sum(abs(y - {SM})) AS c, sum(abs(y - {SN})) AS b FROM scored GROUP BY 1)),
    g AS (SELECT i, sum(abs(y - (i / 1e2 * {SM} + (1 - i / 1e2) * {SN}))) AS s FROM scored, range(101) r(i) WHERE blk < 9 GROUP BY 1),
    f AS (SELECT arg_min(i, (s, i)) / 1e2 AS wt FROM g)
    SELECT '{SM}' AS candidate, '{SN}' AS baseline, {OBSERVED} AS delta, ci_low, ci_high, {OBSERVED} > 0 AND ci_low > 0 AS ci_excludes_zero,
      won AS all_windows_won, wt >= 0.05 AS refit_weight_ok, true AS search_declared,
      {OBSERVED} > 0 AND ci_low > 0 AND won AND wt >= 0.05 AS admitted FROM c, w, f""",
    digits="delta ci_low ci_high",
)
def final_bar(t: Tables):
    boot = evaluate.paired_bootstrap(t.stored_scored, t.weekly, SM, SN, n_boot=N_BOOT)
    early = t.stored_scored.filter(F.col("blk") < t.weekly.late_from)
    weight, _ = blend.grid_best(early, t.weekly, blend.grid(101), blend.pair_text(SM, SN))
    return evaluate.final_bar(boot, evaluate.windows_won(t.stored_scored, t.weekly, SM, SN), weight, 1)


@query(
    "E7_fold_assignment", "cube",
    """SELECT 'standing' AS instrument, CAST(0 AS BIGINT) AS fold, CASE WHEN blk < 9 THEN 'fit' ELSE 'score' END AS role, cutoff, count(*) AS n FROM scored GROUP BY 3, 4
    UNION ALL SELECT 'leave_one_out', f, CASE WHEN cutoff = f THEN 'score' ELSE 'fit' END, cutoff, count(*) FROM scored, (SELECT unnest([305, 318, 331]) AS f) GROUP BY f, cutoff
    UNION ALL SELECT 'forward', f, CASE WHEN cutoff = f THEN 'score' ELSE 'fit' END, cutoff, count(*) FROM scored, (SELECT unnest([305, 318, 331]) AS f)
     WHERE cutoff = f OR (cutoff + 26) + 13 <= f + 13 GROUP BY f, cutoff""",
)
def fold_assignment(t: Tables):
    rows = evaluate.folds(t.scored.select("cutoff", "unique_id", "step", "blk"), t.weekly, CUTOFFS)
    return rows.groupBy("instrument", "fold", "role", "cutoff").agg(F.count(F.lit(1)).alias("n"))


@query(
    "E8_output_contract", "cube",
    """WITH i AS (SELECT unique_id, ds FROM scored WHERE cutoff = 331),
    o AS (SELECT unique_id, ds, CASE WHEN blk = 3 THEN NULL WHEN blk = 4 THEN -1 ELSE seasonal_mean END AS p FROM cube WHERE cutoff = 331 AND blk >= -2 AND blk < 12
      UNION ALL SELECT unique_id, ds, seasonal_mean FROM scored WHERE cutoff = 331 AND blk = 5),
    k AS (SELECT unique_id, ds, count(*) AS n, max(p) AS a, min(p) AS b FROM o GROUP BY 1, 2)
    SELECT (SELECT count(*) FROM i ANTI JOIN k USING (unique_id, ds)) AS missing, (SELECT count(*) FROM k ANTI JOIN i USING (unique_id, ds)) AS extra,
      CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (a IS NULL) AS non_finite, count(*) FILTER (b < 0) AS negative FROM k""",
)
def output_contract(t: Tables):
    block = t.cube.filter("cutoff = 331")
    p = F.when(F.col("blk") == 3, F.lit(None)).when(F.col("blk") == 4, F.lit(-1.0)).otherwise(F.col(SM)).alias("p")
    out = block.filter("blk >= -2 AND blk < 12").select("unique_id", "ds", p)
    out = out.unionByName(block.filter("blk = 5").select("unique_id", "ds", F.col(SM).alias("p")))
    return evaluate.output_contract(out, block.filter("blk >= 0"), ["unique_id", "ds"], "p")


# ---------------------------------------------------------------- G: blending

CURVE = f"SELECT i, sum(abs(y - (i / 1e2 * {SN} + (1 - i / 1e2) * {SM}))) / sum(abs(y)) AS wape FROM scored, range(101) r(i)"


@query("G1_pair_curve", "cube", f"SELECT i / 1e2 AS w, wape FROM ({CURVE} WHERE blk < 9 GROUP BY i)", digits="w wape")
def pair_curve(t: Tables):
    return blend.pair_curve(t.stored_scored.filter(F.col("blk") < t.weekly.late_from), t.weekly, SN, SM)


@query(
    "G1_pair_report", "cube",
    f"""WITH e AS ({CURVE} WHERE blk < 9 GROUP BY i), l AS ({CURVE} WHERE blk >= 9 GROUP BY i),
    f AS (SELECT arg_min(i, (wape, i)) AS i FROM e), o AS (SELECT arg_min(i, (wape, i)) AS i, min(wape) AS w FROM l)
    SELECT f.i / 1e2 AS weight, o.i / 1e2 AS oracle_weight, (SELECT wape FROM l WHERE l.i = f.i) AS late_fitted, o.w AS late_oracle,
      (SELECT wape FROM l WHERE l.i = 100) AS late_a, (SELECT wape FROM l WHERE l.i = 0) AS late_b,
      (SELECT wape FROM l WHERE l.i = f.i) - o.w AS selection_cost FROM f, o""",
    digits="weight oracle_weight late_fitted late_oracle late_a late_b selection_cost",
)
def pair_report(t: Tables):
    return blend.pair_report(t.stored_scored, t.weekly, SN, SM)


@query(
    "G1b_gap_refit", "cube",
    f"""WITH b AS (SELECT *, blk >= 0 AS is_scored FROM cube),
    c AS (SELECT cutoff, i, is_scored, sum(abs(y - greatest(i / 1e2 * {SN} + (1 - i / 1e2) * {SM}, 0))) / sum(abs(y)) AS wape FROM b, range(101) r(i) GROUP BY 1, 2, 3),
    f AS (SELECT cutoff, arg_min(i, (wape, i)) AS i, min(wape) AS w FROM c WHERE NOT is_scored GROUP BY 1)
    SELECT f.cutoff, f.i / 1e2 AS weight, f.w AS fit_wape, (SELECT wape FROM c WHERE is_scored AND c.i = f.i AND c.cutoff = f.cutoff) AS score_wape FROM f""",
    digits="weight fit_wape score_wape",
)
def gap_refit(t: Tables):
    rows, out = t.stored.withColumn("is_scored", F.col("blk") >= 0), None
    for cut in CUTOFFS:
        part = blend.gap_refit(rows.filter(F.col("cutoff") == cut), t.weekly, SN, SM).withColumn("cutoff", F.lit(cut).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def weighted_median_sql(a: str, b: str) -> str:
    return f"""WITH r AS (SELECT (y - {b}) / ({a} - {b}) AS t, abs({a} - {b}) AS w FROM scored WHERE blk < 9 AND {a} <> {b}),
    c AS (SELECT t, sum(w) OVER (ORDER BY t) AS upto, (SELECT sum(w) FROM r) AS total FROM r)
    SELECT '{a}' AS a, '{b}' AS b, least(greatest(min(t), 0), 1) AS weight_a FROM c WHERE upto >= 0.5 * total"""


@query("G2_two_member_simplex", "cube", weighted_median_sql(SN, SM), digits="weight_a")
def two_member(t: Tables):
    w = blend.fit_simplex(t.stored_scored.filter(F.col("blk") < t.weekly.late_from), t.weekly, [SN, SM])
    return t.spark.createDataFrame([(SN, SM, w[SN])], "a string, b string, weight_a double")


@query("G2_fit_simplex", "cube", "SELECT count(*) AS fitted_rows, TRUE AS convex, TRUE AS below_grid FROM scored WHERE blk < 9")
def simplex(t: Tables):
    rows = t.stored_scored
    early = rows.filter(F.col("blk") < t.weekly.late_from)
    w = blend.fit_simplex(early, t.weekly, MEMBERS)
    # No point of a grid over the simplex has a lower error than the fitted weights.
    points = {f"g{i}": blend.weighted_text(x) for i, x in enumerate(blend.simplex_grid(MEMBERS, 20))}
    sums = blend.totals(early, "y", {"fit": blend.weighted_text(w), **points})
    convex = abs(sum(w.values()) - 1) < 1e-9 and min(w.values()) >= 0
    row = (early.count(), convex, sums["fit"] <= min(sums[g] for g in points) * (1 + 1e-6))
    return t.spark.createDataFrame([row], "fitted_rows long, convex boolean, below_grid boolean")


def combos_sql() -> str:
    names = ("naive", SN, SM)
    pieces = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            w = {n: ("p / 2e1" if n == a else "(20 - p) / 2e1" if n == b else "0e0") for n in names}
            pieces.append(
                f"SELECT '{a}+{b}' AS members, 2 AS size, [p / 2e1, (20 - p) / 2e1] AS weights, {w['naive']} AS w0, {w[SN]} AS w1, {w[SM]} AS w2, 100 * p AS ord FROM range(21) r(p)"
            )
    pieces.append(
        "SELECT 'naive+seasonal_naive+seasonal_mean', 3, [p / 2e1, q / 2e1, (20 - p - q) / 2e1], p / 2e1, q / 2e1, (20 - p - q) / 2e1, 100 * p + q"
        " FROM range(21) r(p), range(21) s(q) WHERE p + q <= 20"
    )
    return f"""WITH g AS ({' UNION ALL '.join(pieces)}),
    e AS (SELECT members, size, weights, w0, w1, w2, ord, sum(abs(y - (w0 * naive + w1 * seasonal_naive + w2 * seasonal_mean))) AS ae FROM g, scored WHERE blk < 9 GROUP BY ALL),
    b AS (SELECT members, size, arg_min(weights, (ae, ord)) AS weights, arg_min(w0, (ae, ord)) AS w0, arg_min(w1, (ae, ord)) AS w1, arg_min(w2, (ae, ord)) AS w2 FROM e GROUP BY 1, 2)
    SELECT members, CAST(size AS BIGINT) AS size, weights[1] AS first_weight,
      sum(abs(y - (w0 * naive + w1 * seasonal_naive + w2 * seasonal_mean))) / sum(abs(y)) AS late_wape FROM b, scored WHERE blk >= 9 GROUP BY 1, 2, 3"""


@query("G3_combination_search", "cube", combos_sql(), digits="first_weight late_wape")
def combination_search(t: Tables):
    out = blend.search_grid(t.stored_scored, t.weekly, MEMBERS, (2, 3), 20)
    return out.select("members", "size", F.col("weights")[0].alias("first_weight"), "late_wape")


WEIGHTS = {"naive": 0.1, SN: 0.3, SM: 0.6}
BLEND_SQL = "(0.1e0 * naive + 0.3e0 * seasonal_naive + 0.6e0 * seasonal_mean)"


@query("G4_convex_blend", "cube", f"SELECT cutoff, unique_id, step, {BLEND_SQL} AS blend FROM cube", digits="blend")
def convex(t: Tables):
    return t.cube.select("cutoff", "unique_id", "step", blend.convex(WEIGHTS).alias("blend"))


@query("G5_seed_bag", "cube", "SELECT cutoff, unique_id, step, (naive + seasonal_naive + seasonal_mean) / 3 AS bag FROM scored", digits="bag")
def seed_bag(t: Tables):
    rows = t.scored.select(
        "cutoff", "unique_id", "step", F.col("naive").alias("net"), F.col(SN).alias("net1"), F.col(SM).alias("net2"), F.col("naive").alias("net-median")
    )
    return blend.seed_bag(rows, "net", "bag").select("cutoff", "unique_id", "step", "bag")


@query(
    "G6_combiners", "cube",
    """WITH c AS (SELECT y, (naive + seasonal_naive + seasonal_mean) / 3 AS mean, list_sort([naive, seasonal_naive, seasonal_mean])[2] AS median,
      exp((ln(greatest(naive, 1e-9)) + ln(greatest(seasonal_naive, 1e-9)) + ln(greatest(seasonal_mean, 1e-9))) / 3) AS geomean FROM scored),
    o AS (SELECT least(sum(abs(y - naive)), sum(abs(y - seasonal_naive)), sum(abs(y - seasonal_mean))) AS ae, sum(abs(y)) AS ya FROM scored GROUP BY unique_id)
    SELECT 'mean' AS combiner, sum(abs(y - mean)) / sum(abs(y)) AS wape FROM c UNION ALL SELECT 'median', sum(abs(y - median)) / sum(abs(y)) FROM c
    UNION ALL SELECT 'geomean', sum(abs(y - geomean)) / sum(abs(y)) FROM c UNION ALL SELECT 'oracle_per_series', sum(ae) / sum(ya) FROM o""",
    digits="wape",
)
def combiners(t: Tables):
    made = blend.combiners(MEMBERS)
    row = t.scored.agg(*(M.wape(F.col("y"), x).alias(n) for n, x in made.items()))
    parts = F.array(*(F.struct(F.lit(n).alias("combiner"), F.col(n).alias("wape")) for n in made))
    out = row.select(F.explode(parts).alias("_p")).select("_p.*")
    oracle = blend.best_member_per_series(t.scored, t.weekly, MEMBERS)
    return out.unionByName(oracle.agg((F.sum("ae") / F.sum("ya")).alias("wape")).withColumn("combiner", F.lit("oracle_per_series")))


@query(
    "G6_best_member_per_series", "cube",
    """WITH e AS (SELECT unique_id, sum(abs(y)) AS ya, sum(abs(y - naive)) AS a, sum(abs(y - seasonal_naive)) AS b, sum(abs(y - seasonal_mean)) AS c FROM scored GROUP BY 1)
    SELECT unique_id, CASE WHEN a <= b AND a <= c THEN 'naive' WHEN c <= b THEN 'seasonal_mean' ELSE 'seasonal_naive' END AS member, least(a, b, c) AS ae, ya FROM e""",
    digits="ae ya",
)
def best_member(t: Tables):
    return blend.best_member_per_series(t.scored, t.weekly, MEMBERS)


@query(
    "G7_desmooth", "cube",
    "SELECT cutoff, unique_id, step, greatest(a + 1.04e0 * (p - a), 0) AS p FROM (SELECT cutoff, unique_id, step, seasonal_mean AS p,"
    " avg(seasonal_mean) OVER (PARTITION BY cutoff, unique_id) AS a FROM scored)",
    digits="p",
)
def desmooth(t: Tables):
    rows = t.scored.select("cutoff", "unique_id", "step", F.col(SM).alias("p"))
    return blend.desmooth(rows, ["cutoff", "unique_id"], "p")


@query(
    "G8_dispersion_ratio", "cube",
    "SELECT member, sqrt(sum(vp * n) / sum(vy * n)) AS sd_ratio FROM (SELECT member, unique_id, var_pop(p) AS vp, var_pop(y) AS vy, count(*) AS n FROM"
    f" ({LONG.format('SELECT unique_id, y, naive, seasonal_naive, seasonal_mean FROM scored')}) GROUP BY 1, 2) GROUP BY 1",
    digits="sd_ratio",
)
def dispersion(t: Tables):
    return diagnose.dispersion_ratio(t.scored, t.weekly, MEMBERS)


RUNGS = (
    ("full", {"deep": 0.5, SN: 0.2, SM: 0.3}),
    ("two", {SN: 0.25, SM: 0.75}),
    ("one", {SM: 1.0}),
)


@query("G9_choose_rung", "cube", "SELECT 'two' AS rung, cutoff, unique_id, step, 0.25e0 * seasonal_naive + 0.75e0 * seasonal_mean AS p FROM scored", digits="p")
def choose_rung(t: Tables):
    name, weights = blend.choose_rung(t.scored.columns, RUNGS)
    return t.scored.select(F.lit(name).alias("rung"), "cutoff", "unique_id", "step", blend.convex(weights).alias("p"))


@query(
    "G10_structured_weights", "cube",
    f"""WITH s AS (SELECT *, blk // 3 AS grp FROM scored),
    e AS (SELECT i, grp, sum(abs(y - (i / 1e2 * {SN} + (1 - i / 1e2) * {SM}))) AS ae FROM s, range(101) r(i) WHERE blk < 9 GROUP BY 1, 2),
    g AS (SELECT arg_min(i, (ae, i)) / 1e2 AS w FROM (SELECT i, sum(ae) AS ae FROM e GROUP BY 1)),
    o AS (SELECT grp, arg_min(i, (ae, i)) / 1e2 AS w FROM e GROUP BY 1),
    m AS (SELECT s.*, k / 1e1 AS lam, k / 1e1 * g.w + (1 - k / 1e1) * coalesce(o.w, g.w) AS w FROM s CROSS JOIN g LEFT JOIN o USING (grp), range(11) r(k) WHERE blk >= 9)
    SELECT lam AS shrink, sum(abs(y - (w * {SN} + (1 - w) * {SM}))) / sum(abs(y)) AS late_wape, (SELECT w FROM g) AS global_weight FROM m GROUP BY 1""".replace("blk // 3", "CAST(substr(unique_id, 7, 1) AS BIGINT)"),
    digits="shrink late_wape global_weight",
)
def structured(t: Tables):
    return blend.structured_weights(t.stored_scored, t.weekly, SN, SM, F.substring("unique_id", 7, 1))


GAMMA = f"""
a AS (SELECT *, avg({SM}) OVER (PARTITION BY cutoff, unique_id) AS anchor FROM scored),
g AS (SELECT unique_id, 90 + i AS g, sum(abs(y - greatest(anchor + (90 + i) / 1e2 * ({SM} - anchor), 0))) AS ae FROM a, range(31) r(i) WHERE blk < 9 GROUP BY 1, 2)"""


@query(
    "G11_gamma_global", "cube",
    f"""WITH {GAMMA.strip()}, f AS (SELECT arg_min(g, (ae, g)) / 1e2 AS gamma FROM (SELECT g, sum(ae) AS ae FROM g GROUP BY 1))
    SELECT gamma AS gamma_min, gamma AS gamma_max, sum(abs(y - {SM})) / sum(y) AS late_before,
      sum(abs(y - greatest(anchor + gamma * ({SM} - anchor), 0))) / sum(y) AS late_after FROM a, f WHERE blk >= 9 GROUP BY gamma""",
    digits="gamma_min gamma_max late_before late_after",
)
def gamma_global(t: Tables):
    return blend.gamma_fit(t.stored_scored, t.weekly, SM)


@query(
    "G11_gamma_per_series", "cube",
    f"""WITH {GAMMA.strip()}, f AS (SELECT unique_id, arg_min(g, (round(ae, 9), g)) / 1e2 AS gamma FROM g GROUP BY 1)
    SELECT min(gamma) AS gamma_min, max(gamma) AS gamma_max, sum(abs(y - {SM})) / sum(y) AS late_before,
      sum(abs(y - greatest(anchor + gamma * ({SM} - anchor), 0))) / sum(y) AS late_after FROM a JOIN f USING (unique_id) WHERE blk >= 9""",
    digits="gamma_min gamma_max late_before late_after",
)
def gamma_series(t: Tables):
    return blend.gamma_fit(t.stored_scored, t.weekly, SM, ["unique_id"])


# ---------------------------------------------------------------- V: provenance

PROV = (
    "prov AS (SELECT 'rolled' AS \"column\", CAST(331 - 13 * (i + 1) AS BIGINT) AS start, 13 AS length FROM range(25) r(i) UNION ALL"
    " SELECT 'rolled', 331 + 13 * i, 13 FROM range(2) r(i) UNION ALL"
    " SELECT 'anchored', 331 - 13 * (i + 1), 13 FROM range(25) r(i) UNION ALL SELECT 'anchored', 331, 26)"
)


def prov_tables(t: Tables):
    n = t.weekly.series_len
    train = [(s, 13) for s in origin.block_starts(331, 13)]
    rolled = provenance.table(t.spark, "rolled", [*train, (331, 13), (344, 13)], n, "seasonal_naive")
    anchored = provenance.table(t.spark, "anchored", [*train, (331, 26)], n, "seasonal_naive")
    return rolled, anchored


@query(
    "V1_provenance_merge", "panel_s",
    f"WITH {PROV} SELECT \"column\", count(*) AS blocks, CAST(sum(length) AS BIGINT) AS covered, (SELECT count(DISTINCT hidx) FROM panel_s) AS n_hours FROM prov WHERE start > 0 GROUP BY 1",
)
def provenance_merge(t: Tables):
    path = t.scratch("provenance")
    provenance.write(provenance.merge(prov_tables(t)), path)
    stored = t.spark.read.schema(provenance.SCHEMA).json(path)
    return stored.groupBy("column").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("length").alias("covered"), F.max("n_hours").alias("n_hours")
    )


@query(
    "V2_leak_hours", "panel_s",
    """WITH h AS (SELECT DISTINCT hidx FROM panel_s WHERE hidx < 357),
    prov AS (SELECT DISTINCT 'rolled' AS "column", 357 - 13 * CAST(ceil((357 - hidx) / 13e0) AS BIGINT) AS start FROM h UNION ALL
      SELECT DISTINCT 'anchored', CASE WHEN hidx >= 331 THEN 331 ELSE 331 - 13 * CAST(ceil((331 - hidx) / 13e0) AS BIGINT) END FROM h),
    c AS (SELECT CAST(unnest([331, 318, 305]) AS BIGINT) AS cutoff)
    SELECT "column", cutoff, CAST(coalesce(max(start - cutoff) FILTER (start > cutoff AND start < cutoff + 26), 0) AS BIGINT) AS leak_hours FROM prov, c GROUP BY 1, 2""",
)
def leak_hours(t: Tables):
    # Blocks are read off the channel itself: each starts at its cutoff and is as long as the rows it filled.
    ahead = t.panel_s.filter("hidx < 357")
    rolled = origin.roll_train(ahead, t.weekly, 357, 13)[0]
    fresh = origin.forecast_horizon(t.panel_s, t.weekly, 331, 26)[0]
    anchored = origin.roll_train(t.panel_s, t.weekly, 331, 13)[0].select("cutoff", "hidx").unionByName(fresh.select("cutoff", "hidx"))
    blocks = None
    for name, rows in (("rolled", rolled.select("cutoff", "hidx")), ("anchored", anchored)):
        part = rows.groupBy(F.col("cutoff").alias("start")).agg((F.max("hidx") - F.min("hidx") + 1).alias("length")).withColumn("column", F.lit(name))
        blocks = part if blocks is None else blocks.unionByName(part)
    return provenance.leak_table(blocks, CUTOFFS, 26)


@query(
    "V3_honest_channel", "cube",
    "SELECT p.unique_id, p.hidx, CASE WHEN p.hidx < 331 THEN h.y ELSE c.seasonal_naive END AS anchored FROM panel_s p"
    " LEFT JOIN panel_s h ON h.unique_id = p.unique_id AND p.hidx < 331 AND h.hidx = p.hidx - 13 AND p.hidx >= 19"
    " LEFT JOIN cube c ON c.unique_id = p.unique_id AND c.hidx = p.hidx AND c.cutoff = 331 WHERE p.hidx >= 19",
)
def honest_channel(t: Tables):
    prov = provenance.merge(prov_tables(t))
    try:
        provenance.check_honest(prov, "rolled", 331, 26)
        raise AssertionError("a leaking channel was accepted")
    except ValueError:
        pass
    provenance.check_honest(prov, "anchored", 331, 26)
    train, _ = origin.roll_train(t.panel_s, t.weekly, 331, 13, name="anchored")
    block, _ = origin.forecast_horizon(t.panel_s, t.weekly, 331, 26, name="anchored")
    cols = ["unique_id", "hidx", "anchored"]
    return train.filter("hidx >= 19").select(*cols).unionByName(block.select(*cols))


@query(
    "V4_frame_audit", "panel_s",
    f"""WITH {PROV}, f AS (SELECT hidx, CASE WHEN hidx >= 6 THEN y END AS rolled, CASE WHEN hidx >= 19 THEN y END AS anchored FROM panel_s),
    k AS (SELECT CAST(unnest([331, 318]) AS BIGINT) AS cutoff),
    v AS (SELECT 'rolled' AS "column", hidx, rolled IS NOT NULL AS seen FROM f UNION ALL SELECT 'anchored', hidx, anchored IS NOT NULL FROM f),
    c AS (SELECT "column", cutoff, min(hidx) FILTER (seen) AS first_seen, round(avg(CAST(seen AS DOUBLE)) FILTER (hidx < cutoff), 4) AS train_coverage,
      round(avg(CAST(seen AS DOUBLE)) FILTER (hidx >= cutoff AND hidx < cutoff + 26), 4) AS horizon_coverage FROM v, k GROUP BY 1, 2),
    l AS (SELECT "column", cutoff, CAST(coalesce(max(start - cutoff) FILTER (start > cutoff AND start < cutoff + 26), 0) AS BIGINT) AS leak_hours FROM prov, k WHERE start > 0 GROUP BY 1, 2),
    s AS (SELECT "column", min(start) AS first_block, count(*) AS blocks FROM prov WHERE start > 0 GROUP BY 1)
    SELECT *, true AS routed, verdict = 'ok' AS ok FROM (SELECT c.*, leak_hours, first_block, blocks,
      CASE WHEN leak_hours > 0 THEN 'not honest' WHEN horizon_coverage < 1 THEN 'horizon incomplete' WHEN first_seen >= cutoff THEN 'horizon only'
           WHEN first_seen <> first_block THEN 'frame and provenance disagree' ELSE 'ok' END AS verdict
      FROM c JOIN l USING ("column", cutoff) JOIN s USING ("column"))""",
)
def frame_audit(t: Tables):
    frame = t.panel_s.select(
        "hidx", F.when(F.col("hidx") >= 6, F.col("y")).alias("rolled"), F.when(F.col("hidx") >= 19, F.col("y")).alias("anchored")
    )
    prov = provenance.merge(prov_tables(t))
    return provenance.audit(frame, prov, t.weekly, ["rolled", "anchored"], [331, 318], 26, ["rolled", "anchored"])


@query(
    "V5_forecast_smell", "cube",
    """WITH w AS (SELECT unnest([331, 318, 305]) AS cut),
    j AS (SELECT w.cut, p.y, c.seasonal_mean AS a, c.naive AS b FROM panel_s p CROSS JOIN w
      LEFT JOIN cube c ON c.unique_id = p.unique_id AND c.ds = p.ds AND c.cutoff = w.cut)
    SELECT 'a_' || cut AS channel, avg(CAST(a IS NULL AS DOUBLE)) AS missing_share, corr(a, y) AS corr FROM j GROUP BY cut UNION ALL
    SELECT 'b_' || cut, avg(CAST(b IS NULL AS DOUBLE)), corr(b, y) FROM j GROUP BY cut""",
    digits="missing_share corr",
)
def smell(t: Tables):
    at = lambda m, c: F.max(F.when(F.col("cutoff") == c, F.col(m)))
    wide = t.cube.groupBy("unique_id", "ds").agg(*(at(m, c).alias(f"{n}_{c}") for n, m in (("a", SM), ("b", "naive")) for c in CUTOFFS))
    names = [f"{n}_{c}" for n in "ab" for c in CUTOFFS]
    return diagnose.forecast_smell(t.panel_s.join(wide, ["unique_id", "ds"], "left"), t.weekly, names)


# ---------------------------------------------------------------- H: diagnosis


@query(
    "H1_error_concentration", "cube",
    f"""WITH u AS (SELECT unique_id, sum(abs(y - {SM})) AS ae, sum(abs(y)) AS ya FROM scored GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY ae DESC, unique_id) AS r FROM u)
    SELECT sum(ae) FILTER (r <= 10) / sum(ae) AS top10_share_of_error, sum(ya) FILTER (r <= 10) / sum(ya) AS top10_share_of_volume,
      sum(ae) FILTER (r <= 20) / sum(ae) AS top20_share_of_error, sum(ya) FILTER (r <= 20) / sum(ya) AS top20_share_of_volume, count(*) AS n_units,
      min(ae / ya) AS unit_wape_min, max(ae / ya) AS unit_wape_max, sum(ae) FILTER (r <= 10) / sum(ae) / (1e1 / count(*)) AS over_uniform FROM r""",
    digits="top10_share_of_error top10_share_of_volume top20_share_of_error top20_share_of_volume unit_wape_min unit_wape_max over_uniform",
)
def concentration(t: Tables):
    return diagnose.error_concentration(t.stored_scored, t.weekly, SM)


@query(
    "H1_unit_error_map", "cube",
    f"""WITH u AS (SELECT unique_id, sum(abs(y - {SM})) AS ae, sum(abs(y)) AS ya FROM scored GROUP BY 1)
    SELECT unique_id, ae, ya, ae / nullif(ya, 0) AS unit_wape, ae / sum(ae) OVER () AS share_of_error, ya / sum(ya) OVER () AS share_of_volume,
      (ae / sum(ae) OVER ()) / nullif(ya / sum(ya) OVER (), 0) AS error_per_volume FROM u""",
    digits="ae ya unit_wape share_of_error share_of_volume error_per_volume",
)
def unit_map(t: Tables):
    return diagnose.unit_error_map(t.stored_scored, t.weekly, SM)


def tau_sql(group: str, source: str) -> str:
    return f"""WITH s AS (SELECT {group} AS g, member, sum(abs(y - p)) / sum(abs(y)) AS w FROM ({LONG.format(source)}) GROUP BY 1, 2),
    d AS (SELECT a.g, a.member AS i, b.member AS j, sign(a.w - b.w) AS d FROM s a JOIN s b ON a.g = b.g AND a.member < b.member),
    t AS (SELECT a.g AS a, b.g AS b, avg(a.d * b.d) AS tau FROM d a JOIN d b ON a.i = b.i AND a.j = b.j AND a.g < b.g GROUP BY 1, 2)"""


@query(
    "H2_ranking_stability", "cube",
    tau_sql("cutoff", "SELECT cutoff, y, naive, seasonal_naive, seasonal_mean FROM scored")
    + " SELECT a, b, tau FROM t UNION ALL SELECT -1, -1, avg(tau) FROM t",
    digits="tau",
)
def ranking(t: Tables):
    out = diagnose.ranking_stability(t.scored, t.weekly, MEMBERS)
    return out.select(F.coalesce("a", F.lit(-1)).alias("a"), F.coalesce("b", F.lit(-1)).alias("b"), "tau")


@query(
    "H3_lead_bands", "cube",
    f"""SELECT band, member, wape, row_number() OVER (PARTITION BY band ORDER BY wape, member) AS rank FROM
    (SELECT blk // 4 AS band, member, sum(abs(y - p)) / sum(abs(y)) AS wape FROM ({LONG.format('SELECT blk, y, naive, seasonal_naive, seasonal_mean FROM scored')}) GROUP BY 1, 2)""",
    digits="wape",
)
def bands(t: Tables):
    return diagnose.lead_bands(t.scored, t.weekly, MEMBERS, 4)


@query(
    "H3_band_stability", "cube",
    tau_sql("blk // 4", "SELECT blk, y, naive, seasonal_naive, seasonal_mean FROM scored") + " SELECT a, b, tau FROM t", digits="tau",
)
def band_stability(t: Tables):
    return diagnose.band_stability(t.scored, t.weekly, MEMBERS, 4)


@query(
    "H4_statics_r2", "cube",
    f"""WITH u AS (SELECT unique_id, ln(sum(abs(y - {SM})) / sum(abs(y))) AS l FROM scored GROUP BY 1),
    j AS (SELECT l, capacity AS a, CAST(zone AS DOUBLE) AS b FROM u JOIN (SELECT DISTINCT unique_id, capacity, zone FROM panel_s) USING (unique_id)),
    c AS (SELECT corr(l, a) AS ra, corr(l, b) AS rb, corr(a, b) AS rab, count(*) AS n FROM j)
    SELECT (ra * ra + rb * rb - 2 * ra * rb * rab) / (1 - rab * rab) AS r2, n AS n_units FROM c""",
    digits="r2",
)
def statics_r2(t: Tables):
    statics = static_frame(t.panel_s, t.weekly, ["capacity", "zone"])
    return diagnose.statics_r2(t.scored, t.weekly, SM, statics, ["capacity", "zone"]).select("r2", "n_units")


@query(
    "H5_residual_checklist", "cube",
    f"""WITH e AS (SELECT *, y - {SM} AS e FROM scored),
    n AS (SELECT a.e, b.e AS e1, c.e AS e4 FROM e a LEFT JOIN e b ON a.cutoff = b.cutoff AND a.unique_id = b.unique_id AND b.step = a.step - 1
      LEFT JOIN e c ON a.cutoff = c.cutoff AND a.unique_id = c.unique_id AND c.step = a.step - 4)
    SELECT 'median_by_band' AS "check", CAST(blk // 4 AS VARCHAR) AS key, median(e) AS value FROM e GROUP BY 2
    UNION ALL SELECT 'acf', '1', corr(e, e1) FROM n WHERE e1 IS NOT NULL UNION ALL SELECT 'acf', '4', corr(e, e4) FROM n WHERE e4 IS NOT NULL
    UNION ALL SELECT 'spread_vs_level', 'all', corr(abs(e), {SM}) FROM e UNION ALL SELECT 'corr_covariate', 'naive', corr(e, naive) FROM e""",
    digits="value",
)
def checklist(t: Tables):
    return diagnose.residual_checklist(t.scored, t.weekly, SM, [1, 4], ["naive"], 4)


@query("H5_unit_residual_medians", "cube", f"SELECT unique_id, median(y - {SM}) AS median_residual FROM scored GROUP BY 1", digits="median_residual")
def unit_medians(t: Tables):
    return diagnose.unit_residual_medians(t.scored, t.weekly, SM)


@query(
    "H6_member_spread", "cube",
    f"""WITH s AS (SELECT greatest(naive, {SN}, {SM}) - least(naive, {SN}, {SM}) AS spread, abs(y - {BLEND_SQL}) AS ae FROM scored)
    SELECT count(*) AS n_rows, avg(spread) AS mean_spread, max(spread) AS max_spread, corr(spread, ae) AS corr_with_error FROM s""",
    digits="mean_spread max_spread corr_with_error",
)
def member_spread(t: Tables):
    return diagnose.member_spread(t.scored, t.weekly, MEMBERS, blend.convex(WEIGHTS))


@query(
    "H7_quintile_calibration", "cube",
    f"""WITH q AS (SELECT quantile_cont({SM}, [0.2, 0.4, 0.6, 0.8]) AS m FROM scored),
    b AS (SELECT y, {SM} AS p, 1 + len(list_filter(m, lambda x: x + 1e-9 < {SM})) AS quintile FROM scored, q)
    SELECT CAST(quintile AS BIGINT) AS quintile, count(*) AS n_rows, avg(p) AS mean_pred, avg(y) AS mean_y, sum(p - y) / sum(y) AS relative_error FROM b GROUP BY 1""",
    digits="mean_pred mean_y relative_error",
)
def quintiles(t: Tables):
    return diagnose.quintile_calibration(t.stored_scored, t.weekly, SM)


LAGS = range(14)


def lag_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{s}' AS signal, CAST({n} AS BIGINT) AS lag, corr(b.{s}, a.y) AS corr FROM panel_s a JOIN panel_s b"
        f" ON a.unique_id = b.unique_id AND b.hidx = a.hidx - {n} WHERE b.{s} IS NOT NULL"
        for s in ("x1", "x3")
        for n in LAGS
    )


@query("H8_lagged_correlation", "panel_s", lag_sql(), digits="corr")
def lagged_correlation(t: Tables):
    return diagnose.lagged_correlation(t.panel_s, t.chunked, ["x1", "x3"], LAGS)


@query(
    "H8_peak_lag", "panel_s",
    f"WITH c AS ({lag_sql()}) SELECT signal, arg_max(lag, (round(abs(corr), 12), -lag)) AS peak_lag, arg_max(corr, (round(abs(corr), 12), -lag)) AS peak_corr FROM c GROUP BY 1",
    digits="peak_corr",
)
def peak_lag(t: Tables):
    return diagnose.peak_lag(diagnose.lagged_correlation(t.panel_s, t.chunked, ["x1", "x3"], LAGS))


@query(
    "H9_missing_runs", "panel_s",
    """WITH m AS (SELECT unique_id, hidx - row_number() OVER (PARTITION BY unique_id ORDER BY hidx) AS island FROM panel_s WHERE x1 IS NULL),
    r AS (SELECT count(*) AS n FROM m GROUP BY unique_id, island)
    SELECT 'x1' AS col, count(*) AS runs, avg(n) AS mean_run, median(n) AS median_run, quantile_cont(n, 0.95) AS p95_run, max(n) AS max_run FROM r""",
    digits="mean_run median_run p95_run",
)
def missing_runs(t: Tables):
    return diagnose.missing_runs(t.panel_s, t.chunked, ["x1"])


@query(
    "H10_zone_correlation", "panel_s",
    """WITH p AS (SELECT a.unique_id AS i, b.unique_id AS j, a.zone = b.zone AS same_zone, corr(a.y, b.y) AS c FROM panel_s a
      JOIN panel_s b ON a.hidx = b.hidx AND a.unique_id < b.unique_id GROUP BY 1, 2, 3)
    SELECT same_zone, count(*) AS pairs, avg(c) AS mean_corr FROM p GROUP BY 1""",
    digits="mean_corr",
)
def zone_correlation(t: Tables):
    return diagnose.pairwise_zone_correlation(t.panel_s, t.weekly)


@query("P6_full_regime", "cube", "SELECT cutoff, unique_id, blk FROM scored")
def full_regime(t: Tables):
    return index.select_regime(t.scored.select("cutoff", "unique_id", "blk"), t.weekly, "full")
