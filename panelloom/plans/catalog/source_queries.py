"""Source, sink and store queries, and runs that fit models."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelloom.functions import metrics as M
from panelloom.operators import boosting, blocks, evaluate, impute, index, members, origin, runners
from panelloom.operators.members import TreeConfig
from panelloom.plans import workflows
from panelloom.plans.registry import query
from panelloom.plans.tables import CUTOFFS, MEMBERS, SIGNALS, Tables
from panelloom.sources import cubes, panel_files, results, retail

CUT = 331
DOUBLES = [*SIGNALS, "capacity"]


def each(template: str, sep: str = ", ", cols=SIGNALS) -> str:
    return sep.join(template.replace("@", c) for c in cols)


def write_raw(t: Tables, path: str) -> str:
    """The weekly panel as a labelled CSV, missing cells written as NaN."""
    cols = [F.coalesce(F.col(c), F.lit(float("nan"))).alias(c) for c in DOUBLES]
    raw = t.panel_s.select(F.col("unique_id").alias("series_id"), F.col("ds").alias("timestamp"), F.col("y").alias("target"), *cols)
    raw.write.csv(path, header=True)
    return path


MED = f"med AS (SELECT unique_id, {each('median(@) AS m_@')} FROM panel_s GROUP BY 1)"
FILLED = f"SELECT unique_id, ds, y, {each('coalesce(@, m_@) AS @')}, {each('CAST(@ IS NULL AS DOUBLE) AS @_missing')} FROM panel_s JOIN med USING (unique_id)"


@query("S1_load_long", "panel_s", f"WITH {MED} {FILLED}", digits=SIGNALS)
def load_long(t: Tables):
    path = write_raw(t, t.scratch("labelled.csv"))
    long, _ = panel_files.load_long(t.spark, path, panel_files.schema(DOUBLES), t.weekly)
    return long.drop("capacity")


@query("S2_load_window", "panel_s", f"WITH {MED.replace('GROUP BY', 'WHERE hidx < 305 GROUP BY')} {FILLED}", digits=SIGNALS)
def load_window(t: Tables):
    out = panel_files.load_window_long(t.panel_s.drop("hidx"), t.weekly, 305)
    return out.drop("hidx", "capacity", "zone")


@query("S3_index_and_covariates", "panel_s", "SELECT unique_id AS series_id, ds AS timestamp, x1, x3, row_number() OVER (ORDER BY ds DESC, unique_id) - 1 AS _order FROM panel_s WHERE hidx >= 344", digits="x1 x3")
def index_and_covariates(t: Tables):
    folder = t.scratch("inputs")
    rows = t.panel_s.filter("hidx >= 344").select(F.col("unique_id").alias("series_id"), F.col("ds").alias("timestamp"), "x1", "x3")
    asked = rows.select("series_id", "timestamp").orderBy(F.desc("timestamp"), "series_id")
    asked.write.csv(f"{folder}/forecast_index_b.csv", header=True)  # several files, in order
    rows.limit(0).select("series_id", "timestamp").write.csv(f"{folder}/forecast_index_c.csv", header=True)
    rows.write.csv(f"{folder}/validation_input.csv", header=True)
    wanted = panel_files.load_forecast_index(t.spark, folder)
    cov = panel_files.load_covariates(t.spark, folder, ["x1", "x3"])
    return wanted.join(cov, ["series_id", "timestamp"], "left")


@query(
    "S4_parquet_scan", "",
    "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (3, 7))"
    " UNION ALL SELECT l_orderkey, l_quantity FROM lineitem WHERE l_suppkey IN (5, 11)",
)
def parquet_scan(t: Tables):
    path = f"{t.folder}/lineitem.parquet"
    ids = t.read("supplier").filter(F.col("s_nationkey").isin(3, 7)).select(F.col("s_suppkey").alias("l_suppkey"))
    joined = panel_files.scan_parquet(t.spark, path, ["l_orderkey", "l_quantity"], "l_suppkey", ids)
    return joined.unionByName(panel_files.scan_parquet(t.spark, path, ["l_orderkey", "l_quantity"], "l_suppkey", [5, 11]))


@query("S5_pruned_csv", "panel_s", "SELECT unique_id AS series_id, count(x1) AS seen, count(*) AS n FROM panel_s GROUP BY 1")
def pruned_csv(t: Tables):
    raw = panel_files.read_raw(t.spark, write_raw(t, t.scratch("pruned.csv")), panel_files.schema(DOUBLES))
    return raw.select("series_id", "x1").groupBy("series_id").agg(F.count("x1").alias("seen"), F.count(F.lit(1)).alias("n"))


@query(
    "S6_prediction_sink", "cube",
    "SELECT cutoff, unique_id AS series_id, ds AS timestamp, seasonal_mean AS prediction FROM scored", digits="prediction",
)
def prediction_sink(t: Tables):
    out = None
    for cut in CUTOFFS:
        path = t.scratch(f"predictions_{cut}.csv")
        rows = t.scored.filter(F.col("cutoff") == cut).select(
            F.col("unique_id").alias("series_id"), F.col("ds").alias("timestamp"), F.col("seasonal_mean").alias("prediction")
        )
        panel_files.write_predictions(rows, path, ["series_id", "timestamp"], "prediction")
        part = t.spark.read.schema("series_id string, timestamp timestamp, prediction double").csv(path, header=True)
        part = part.withColumn("cutoff", F.lit(cut).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


@query("S7_member_cube_store", "cube", "SELECT cutoff, unique_id, ds, y, seasonal_mean, 2 AS keys_refused FROM scored", digits="seasonal_mean")
def cube_store(t: Tables):
    root, name = t.scratch("cubes"), "seasonal_mean"
    key = cubes.cache_key(
        name, train_identity=cubes.frame_identity(t.panel_s), cutoffs=[331, 318, 305], seed=None, config={"season": 13}, code="v1"
    )
    cubes.store(t.scored.select("cutoff", "unique_id", "ds", "y", name), root, name, key)
    others = [{**key, "nan_fill": "interp"}, {**key, "train_identity": "0:0"}]
    refused = sum(cubes.load(t.spark, root, name, k) is None for k in others)
    return cubes.load(t.spark, root, name, key).withColumn("keys_refused", F.lit(refused))


@query(
    "S8_attach_column", "cube",
    "SELECT p.unique_id, p.ds, p.y, c.seasonal_mean AS channel FROM panel_s p LEFT JOIN (SELECT * FROM cube WHERE cutoff = 331) c USING (unique_id, ds)",
    digits="channel",
)
def attach_column(t: Tables):
    pred = t.cube.filter("cutoff = 331").select("unique_id", "ds", F.col("seasonal_mean").alias("channel"))
    return panel_files.attach_column(t.panel_s.select("unique_id", "ds", "y"), pred, ["unique_id", "ds"], "channel")


@query(
    "S9_results_summary", "cube",
    """WITH c AS (SELECT member, avg(w) AS cv_wape, stddev_pop(w) AS cv_std FROM (SELECT member, cutoff, sum(abs(y - p)) / sum(abs(y)) AS w FROM
      (UNPIVOT (SELECT cutoff, y, naive, seasonal_naive, seasonal_mean FROM scored) ON naive, seasonal_naive, seasonal_mean INTO NAME member VALUE p) GROUP BY 1, 2) GROUP BY 1)
    SELECT member AS name, 'baseline' AS model, CASE WHEN member <> 'naive' THEN cv_wape END AS cv_wape, CASE WHEN member <> 'naive' THEN cv_std END AS cv_std FROM c""",
    digits="cv_wape cv_std",
)
def results_summary(t: Tables):
    folder = t.scratch("results")
    report = evaluate.pooled_wape(t.stored_scored, t.weekly, MEMBERS, "full").filter("cutoff IS NOT NULL")
    scores = report.groupBy("member").agg(F.avg("wape").alias("cv_wape_mean"), F.stddev_pop("wape").alias("cv_wape_std"))
    for m in MEMBERS:
        # One file per run; one of them was run without cross-validation.
        cv = F.struct("cv_wape_mean", "cv_wape_std")
        row = scores.filter(F.col("member") == m).select(
            F.lit(m).alias("name"), F.lit("baseline").alias("model"), F.when(F.lit(m != "naive"), cv).alias("cross_validation")
        )
        row.coalesce(1).write.json(f"{folder}/{m}")
    scores.limit(1).select(F.lit(1).alias("unrelated")).coalesce(1).write.json(f"{folder}/notes")
    return results.summarize(t.spark, f"{folder}/*").select("name", "model", "cv_wape", "cv_std")


@query(
    "S10_label_encode", "",
    "SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS l_returnflag, dense_rank() OVER (ORDER BY l_partkey) - 1 AS l_partkey FROM lineitem",
)
def label_encode(t: Tables):
    rows = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    return panel_files.label_codes(rows, ["l_returnflag", "l_partkey"])


@query(
    "S12_training_arrays", "panel_s",
    "SELECT unique_id, hidx // 64 AS part, count(*) AS n, sum(y) AS y_sum, arg_max(y, hidx) AS y_last, arg_min(y, hidx) AS y_first FROM panel_s WHERE hidx < 331 GROUP BY 1, 2",
)
def training_arrays(t: Tables):
    out = panel_files.training_arrays(t.panel_s, t.chunked, CUT, SIGNALS)
    total = F.aggregate("y", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return out.select(
        "unique_id", F.col("part").cast("long").alias("part"), F.size("y").cast("long").alias("n"), total.alias("y_sum"),
        F.element_at("y", -1).cast("double").alias("y_last"), F.element_at("y", 1).cast("double").alias("y_first"),
    )


@query(
    "Y1_stratified_ids", "",
    """WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS size FROM customer GROUP BY 1, 2),
    q AS (SELECT *, floor(size * 200 / 15e2 * 15e2 / (SELECT sum(size) FROM c)) AS f, round(size * 200e0 / (SELECT sum(size) FROM c) - floor(size * 200e0 / (SELECT sum(size) FROM c)), 9) AS r FROM c),
    k AS (SELECT *, floor(size * 200e0 / (SELECT sum(size) FROM c)) + CASE WHEN row_number() OVER (ORDER BY r DESC, c_nationkey, c_mktsegment)
      <= 200 - (SELECT sum(floor(size * 200e0 / (SELECT sum(size) FROM c))) FROM c) THEN 1 ELSE 0 END AS take FROM q)
    SELECT c_custkey FROM customer JOIN k USING (c_nationkey, c_mktsegment)
    QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY md5('42:' || c_custkey), c_custkey) <= take""",
)
def stratified(t: Tables):
    rows = t.read("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return retail.stratified_ids(rows, t.weekly.with_(id="c_custkey"), 200, 42, ["c_nationkey", "c_mktsegment"])


# ---------------------------------------------------------------- fitted members

SMALL = TreeConfig(rounds=8, depth=4, stride=26, futr=("x1", "x2"), statics=("capacity",), fc_lags=(26, 52), step=0.2)


def filled(t: Tables):
    stats = impute.fit_fill_stats(t.kept_s.filter(F.col("hidx") < CUT), t.weekly)
    return impute.apply_fill(t.kept_s, t.weekly, stats)


def shape(t: Tables, rows, pred: str, arm=None):
    """What holds of any sound forecast: per step its rows and series, none missing or negative; overall better than the last value."""
    base = t.cube.filter(F.col("cutoff") == CUT).select("unique_id", "ds", F.col("y").alias("_y"), F.col("naive").alias("_n"), F.col("step").alias("_step"))
    joined = rows.join(base, ["unique_id", "ds"]).withColumn("arm", arm if arm is not None else F.lit(pred))
    p = F.col(pred)
    out = joined.groupBy("arm", F.col("_step").alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("unique_id").alias("series"), F.every((p >= 0) & ~F.isnan(p)).alias("sound"),
        F.sum(F.abs(F.col("_y") - p)).alias("_ae"), F.sum(F.abs(F.col("_y") - F.col("_n"))).alias("_an"),
    )
    whole = Window.partitionBy("arm")
    return out.select("arm", "step", "n", "series", "sound", (F.sum("_ae").over(whole) < F.sum("_an").over(whole)).alias("below_naive"))


def shape_sql(first: int, *arms: str, last: int = 26) -> str:
    return (
        f"SELECT arm, step, count(*) AS n, count(DISTINCT unique_id) AS series, TRUE AS sound, TRUE AS below_naive FROM cube,"
        f" (SELECT unnest({list(arms)}) AS arm) WHERE cutoff = {CUT} AND step BETWEEN {first} AND {last} GROUP BY 1, 2"
    )


@query("D10_tree_member", "cube", shape_sql(14, "tree", "unit"))
def tree_member(t: Tables):
    # With and without the unit as a category.
    rows = filled(t)
    plain = shape(t, members.predict_gapped(rows, t.weekly, CUT, SMALL), "tree")
    unit = members.predict_gapped(rows, t.weekly, CUT, replace(SMALL, unit=True), name="unit")
    return plain.unionByName(shape(t, unit, "unit"))


def split_panel(t: Tables):
    """Train rows with two features of few values, whose bins are the values."""
    rows = t.panel_s.filter(F.col("hidx") < CUT).select("unique_id", "hidx", "y", F.col("zone").cast("double").alias("zone"), (F.col("hidx") % 13).cast("double").alias("phase"))
    return rows.withColumn("weight", F.lit(1.0))


def split_forecast(t: Tables, **options):
    from panelloom.session import checkpointed

    rows = checkpointed(split_panel(t))
    forest = boosting.fit(rows, ["zone", "phase"], "y", "weight", F.xxhash64("unique_id", "hidx"), rounds=1, step=1.0, least=20, narrow=0.0, **options)
    cells = rows.select("zone", "phase").distinct()
    return boosting.forecast(forest, cells, "p").select(F.col("zone").cast("long").alias("zone"), F.col("phase").cast("long").alias("phase"), "p")


# Every split of the rows of a leaf on zone (f = 0) or phase (f = 1), by the sums of a gradient g.
SPLIT_ROWS = f"d AS (SELECT zone, hidx % 13 AS phase, y FROM panel_s WHERE hidx < {CUT}), v AS (SELECT DISTINCT 0 AS f, zone AS v FROM d UNION SELECT DISTINCT 1, phase FROM d)"
SPLIT_GAIN = "CASE WHEN least(nl, n - nl) >= 20 THEN greatest(gl * gl / nl + (g - gl) * (g - gl) / (n - nl) - g * g / n, 0) ELSE 0 END"


@query(
    "D10_one_split", "panel_s",
    f"""WITH {SPLIT_ROWS},
    s AS (SELECT min(y) AS m FROM (SELECT y, row_number() OVER (ORDER BY y) AS i, count(*) OVER () AS n FROM d) WHERE 2 * i >= n),
    g AS (SELECT zone, phase, y, sign(m - y)::DOUBLE AS g FROM d, s),
    e AS (SELECT f, v, sum(g) FILTER (CASE f WHEN 0 THEN zone ELSE phase END <= v) AS gl, count(*) FILTER (CASE f WHEN 0 THEN zone ELSE phase END <= v) AS nl, sum(g) AS g, count(*) AS n
      FROM g, v GROUP BY ALL),
    b AS (SELECT f, v FROM e ORDER BY {SPLIT_GAIN} DESC, f, v LIMIT 1),
    x AS (SELECT zone, phase, y, CASE f WHEN 0 THEN zone ELSE phase END <= v AS l FROM d, b),
    m AS (SELECT l, min(y) AS p FROM (SELECT y, l, row_number() OVER (PARTITION BY l ORDER BY y) AS i, count(*) OVER (PARTITION BY l) AS n FROM x) WHERE 2 * i >= n GROUP BY l)
    SELECT DISTINCT zone, phase, p FROM x JOIN m USING (l)""",
    digits="p",
)
def one_split(t: Tables):
    return split_forecast(t, leaves=2, loss="absolute")


@query(
    "D12_symmetric_levels", "panel_s",
    f"""WITH {SPLIT_ROWS},
    g AS (SELECT zone, phase, y, (SELECT avg(y) FROM d) - y AS g FROM d),
    e AS (SELECT f, v, sum(g) FILTER (CASE f WHEN 0 THEN zone ELSE phase END <= v) AS gl, count(*) FILTER (CASE f WHEN 0 THEN zone ELSE phase END <= v) AS nl, sum(g) AS g, count(*) AS n
      FROM g, v GROUP BY ALL),
    b AS (SELECT f, v FROM e ORDER BY {SPLIT_GAIN} DESC, f, v LIMIT 1),
    x AS (SELECT zone, phase, y, g, CASE f WHEN 0 THEN zone ELSE phase END <= v AS l FROM g, b),
    e2 AS (SELECT f, v, l, sum(g) FILTER (CASE f WHEN 0 THEN zone ELSE phase END <= v) AS gl, count(*) FILTER (CASE f WHEN 0 THEN zone ELSE phase END <= v) AS nl, sum(g) AS g, count(*) AS n
      FROM x, v GROUP BY ALL),
    b2 AS (SELECT f, v FROM e2 GROUP BY f, v ORDER BY sum({SPLIT_GAIN.replace("gl * gl / nl", "coalesce(gl, 0) * coalesce(gl, 0) / nl").replace("(g - gl) * (g - gl)", "(g - coalesce(gl, 0)) * (g - coalesce(gl, 0))")}) DESC, f, v LIMIT 1),
    z AS (SELECT zone, phase, y, l, CASE f WHEN 0 THEN zone ELSE phase END <= v AS l2 FROM x, b2),
    m AS (SELECT l, l2, avg(y) AS p FROM z GROUP BY ALL)
    SELECT DISTINCT zone, phase, p FROM z JOIN m USING (l, l2)""",
    digits="p",
)
def symmetric_levels(t: Tables):
    return split_forecast(t, symmetric=True, depth=2, loss="squared")


@query(
    "D11_tune_rounds", "panel_s",
    f"SELECT count(DISTINCT unique_id) > 0 AS fitted, 12 AS max_rounds, {CUT} - 13 AS valid_from, {CUT} AS valid_to, TRUE AS within, TRUE AS scored FROM panel_s",
)
def tune_rounds(t: Tables):
    r = members.tune_rounds(filled(t), t.weekly, CUT, SMALL, 12, 3)
    row = (r["n_train_rows"] > r["n_valid_rows"] > 0, r["max_rounds"], r["valid_from"], r["valid_to"], 1 <= r["best_iteration"] <= 12, r["best_score"] > 0)
    return t.spark.createDataFrame([row], "fitted boolean, max_rounds long, valid_from long, valid_to long, within boolean, scored boolean")


@query("D12_second_tree_family", "cube", shape_sql(14, "tree2"))
def second_tree(t: Tables):
    config = replace(members.symmetric_config(SMALL), step=0.2)
    return shape(t, members.predict_gapped(filled(t), t.weekly, CUT, config, name="tree2"), "tree2")


@query("D13_recursive_trees", "cube", shape_sql(1, "recursive"))
def recursive(t: Tables):
    config = replace(SMALL, futr=("x1",))
    return shape(t, members.recursive_trees(filled(t), t.weekly, CUT, 26, config, (1, 2, 4, 13, 26), 4), "recursive")


@query("D14_residual_member", "cube", shape_sql(14, "corrected"))
def residual(t: Tables):
    start = t.kept_s.select("unique_id", F.col("hidx").alias("_o"), F.col("ds").alias("_cut"))
    oof = t.cube.filter("cutoff < 331").withColumn("_o", F.col("cutoff") - 1).join(start, ["unique_id", "_o"])
    oof = oof.select("unique_id", "ds", F.col("_cut").alias("cutoff"), "y", "seasonal_mean")
    preds = t.scored.filter("cutoff = 331").select("unique_id", "ds", "y", "seasonal_mean")
    return shape(t, members.residual_member(filled(t), t.weekly, CUT, oof, preds, "seasonal_mean", SMALL), "corrected")


RIDGE = f"""WITH k AS (SELECT * FROM panel_s WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL),
    m AS (SELECT avg(y) AS my, stddev_pop(y) AS sy, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, stddev_pop(x3) AS s3,
      corr(x1, x2) AS a, corr(x1, x3) AS b, corr(x2, x3) AS c, corr(x1, y) AS p, corr(x2, y) AS q, corr(x3, y) AS r, 1 + 1 / stddev_pop(y) AS d FROM k WHERE hidx < {CUT}),
    w AS (SELECT *, d * d * d + 2 * a * b * c - d * (a * a + b * b + c * c) AS det FROM m),
    v AS (SELECT *, (p * (d * d - c * c) - q * (a * d - b * c) + r * (a * c - b * d)) / det * sy / s1 AS w1,
      (q * (d * d - b * b) - p * (a * d - b * c) - r * (c * d - a * b)) / det * sy / s2 AS w2,
      (r * (d * d - a * a) + p * (a * c - b * d) - q * (c * d - a * b)) / det * sy / s3 AS w3 FROM w)
    SELECT unique_id, ds, hidx - {CUT} + 1 AS step, y, greatest(my + w1 * (x1 - m1) + w2 * (x2 - m2) + w3 * (x3 - m3), 0) AS ridge
    FROM k, v WHERE hidx >= {CUT} AND hidx < {CUT} + 26"""


@query("D15_ridge_control", "panel_s", RIDGE, digits={"ridge": 5})
def ridge(t: Tables):
    return members.ridge_control(t.panel_s, t.weekly, CUT, 26, SIGNALS).drop("cutoff")


@query(
    "D16_residual_target", "cube",
    "SELECT unique_id, ds, seasonal_naive + (SELECT avg(p.y - h.y) FROM panel_s p JOIN panel_s h ON h.unique_id = p.unique_id AND h.hidx = p.hidx - 13"
    " WHERE p.hidx < 331 AND p.unique_id = c.unique_id) AS p FROM cube c WHERE cutoff = 331",
    digits="p",
)
def residual_target(t: Tables):
    # A level model on (y - channel): its constant per series is added to the channel again.
    back = t.panel_s.select("unique_id", (F.col("hidx") + 13).alias("hidx"), F.col("y").alias("channel"))
    train = t.panel_s.filter("hidx < 331").join(back, ["unique_id", "hidx"])
    rest = members.to_residual_target(train, t.weekly, "channel").groupBy("unique_id").agg(F.avg("y").alias("p"))
    frame = t.cube.filter("cutoff = 331").select("unique_id", "ds", F.col("seasonal_naive").alias("channel"))
    preds = frame.select("unique_id", "ds").join(rest, "unique_id")
    return members.from_residual_target(preds, frame, t.weekly, "channel", "p").select("unique_id", "ds", "p")


@query(
    "D17_residual_stacker", "cube",
    """WITH l AS (SELECT count(*) AS n_rows, sum(abs(y - 0.4e0 * seasonal_naive - 0.6e0 * seasonal_mean)) / sum(abs(y)) AS blend_wape FROM scored WHERE blk >= 9)
    SELECT arm, n_rows, blend_wape, TRUE AS on_grid, TRUE AS sound FROM l, (SELECT unnest(['all', 'no_clock']) AS arm)""",
    digits="blend_wape",
)
def stacker(t: Tables):
    cov = filled(t).select("unique_id", "ds", "x1", "x2", "capacity")
    from panelloom.session import checkpointed

    cube = checkpointed(t.scored.join(cov, ["unique_id", "ds"]))
    mix = 0.4 * F.col("seasonal_naive") + 0.6 * F.col("seasonal_mean")
    early = F.col("blk") < t.weekly.late_from
    clock_free = ["x1", "x2", "capacity"]
    config = TreeConfig(rounds=5, depth=3, step=0.2)
    out = None
    for name, features in (("all", [*clock_free, "blk"]), ("no_clock", clock_free)):
        part = members.residual_stacker(cube, t.weekly, mix, MEMBERS, features, early, ~early, config).withColumn("arm", F.lit(name))
        out = part if out is None else out.unionByName(part)
    on_grid = F.col("gamma").isin(list(members.STACK_GRID))
    return out.select("arm", "n_rows", "blend_wape", on_grid.alias("on_grid"), (F.col("stacked_wape") < 1.5 * F.col("blend_wape")).alias("sound"))


@query("R7_arms_one_fit", "cube", shape_sql(1, "real", "median", "ffill_decay"))
def arms(t: Tables):
    df = filled(t)
    config = TreeConfig(**{**SMALL.__dict__, "futr": ("x1", "x2")})
    member = members.fit_gapped(df, t.weekly, CUT, config)
    future, history = index.gapped_horizon(df, t.weekly, CUT), df.filter(F.col("hidx") < CUT)
    frames = {"real": future}
    for s in ("median", "ffill_decay"):
        frames[s] = impute.withhold_gap(future, history, t.weekly, 13, ["x1", "x2"], strategy=s)
    return shape(t, members.predict_arms(df, t.weekly, member, frames), "tree", F.col("arm"))


@query("R7_member_runner", "cube", shape_sql(14, "tree_level"))
def member_runner(t: Tables):
    ctx = runners.Context(filled(t), t.weekly, CUT, seed=7, gap_fill="ffill_decay", config=SMALL)
    return shape(t, runners.run_member("tree_level", ctx), "tree_level")


@query(
    "Y2_run_panel", "cube",
    """SELECT arm, CASE WHEN arm = 'absent' THEN 'unknown arm' ELSE 'ok' END AS status, arm <> 'absent' AS scored
    FROM (SELECT unnest(['naive', 'seasonal_naive', 'seasonal_mean', 'channel', 'tree', 'recursive', 'absent', 'blend', 'blend_refit']) AS arm) WHERE (SELECT count(*) FROM scored) > 0""",
)
def run_panel(t: Tables):
    config = TreeConfig(rounds=5, depth=3, stride=52, step=0.2)
    out = workflows.run_panel(t.kept_s, t.weekly, config, ("naive", "seasonal_naive", "seasonal_mean", "channel", "tree", "recursive", "absent"))
    return out.select("arm", "status", F.coalesce(F.col("wape").between(0, 3), F.lit(False)).alias("scored"))


@query(
    "Y2_baseline_arms", "panel_s",
    """WITH w AS (SELECT p.unique_id, p.hidx, p.y, l.y AS naive, s.y AS seasonal_naive, (SELECT avg(h.y) FROM panel_s h WHERE h.unique_id = p.unique_id AND h.hidx < 331
      AND h.hidx % 13 = p.hidx % 13) AS seasonal_mean FROM panel_s p JOIN panel_s l ON l.unique_id = p.unique_id AND l.hidx = 330
      JOIN panel_s s ON s.unique_id = p.unique_id AND s.hidx = 318 + (p.hidx - 331) % 13 WHERE p.hidx >= 344),
    m AS (SELECT member AS arm, sum(abs(y - p)) / sum(abs(y)) AS wape, round(avg(CAST(y = 0 AS DOUBLE)), 6) AS zero_frac
      FROM (UNPIVOT w ON naive, seasonal_naive, seasonal_mean INTO NAME member VALUE p) GROUP BY 1)
    SELECT arm, 'ok' AS status, wape, zero_frac, 1 - wape / (SELECT wape FROM m WHERE arm = 'seasonal_naive') AS skill FROM m""",
    digits="wape skill",
)
def baseline_arms(t: Tables):
    out = workflows.run_panel(t.kept_s, t.weekly, TreeConfig(), MEMBERS)
    return out.select("arm", "status", "wape", "zero_frac", "skill")


@query(
    "S6_inference_run", "panel_s",
    f"""WITH h AS (SELECT unique_id, hidx % 13 AS ph, avg(y) AS m FROM panel_s WHERE hidx < {CUT} GROUP BY 1, 2),
    p AS (SELECT unique_id, p.ds, 0.25e0 * s.y + 0.75e0 * h.m AS p FROM panel_s p JOIN h USING (unique_id)
      JOIN (SELECT unique_id AS u, hidx, y FROM panel_s) s ON s.u = p.unique_id AND s.hidx = 318 + (p.hidx - {CUT}) % 13
      WHERE p.hidx >= 344 AND h.ph = p.hidx % 13)
    SELECT unique_id, ds, greatest(a + 1.04e0 * (p - a), 0) AS prediction, 'two' AS rung FROM (SELECT *, avg(p) OVER (PARTITION BY unique_id) AS a FROM p)""",
    digits="prediction",
)
def inference_run(t: Tables):
    spec = t.weekly
    history = t.kept_s.filter(F.col("hidx") < CUT)
    future = t.kept_s.filter("hidx >= 344").select("unique_id", "ds", *SIGNALS)

    def native(method):
        def run(whole, cut, h):
            return origin.forecast_horizon(whole, spec, cut, h, method, method)[0]

        return run

    def broken(whole, cut, h):
        raise RuntimeError("weights are not available offline")

    members_here = {"seasonal_naive": native("seasonal_naive"), "seasonal_mean": native("seasonal_mean"), "deep": broken}
    rungs = (("full", {"deep": 0.5, "seasonal_mean": 0.5}), ("two", {"seasonal_naive": 0.25, "seasonal_mean": 0.75}))
    out, rung = workflows.predict(
        history, future, panel_files.with_order(future.select("unique_id", "ds")), spec, members_here, rungs,
        aggregates=["xs_cap_x1"],
        block_registry=lambda s: blocks.registry(s, CUT, live=["x1"], given=["x1"], refill=[], memory=["x1"], asymmetric=["x1"]),
    )
    return out.select("unique_id", "ds", "prediction", F.lit(rung).alias("rung"))


@query(
    "S6_graded_run", "panel_s",
    """SELECT unique_id, ds, 'tree and rolled' AS rung, TRUE AS sound, TRUE AS below_naive, count(*) OVER () AS n FROM panel_s WHERE hidx BETWEEN 331 AND 356""",
)
def graded_run(t: Tables):
    # Fitted for 26 steps, asked for steps 14 to 39: the tree answers them directly, the seasonal member rolls forward.
    spec, cut = t.weekly, 318
    history = t.kept_s.filter(F.col("hidx") < cut)
    asked = t.kept_s.filter(F.col("hidx").between(331, 356))
    index_rows = panel_files.with_order(asked.select("unique_id", "ds").orderBy(F.xxhash64("unique_id", "ds")))
    aggregates = ["xs_cap_x1", "ew_x1_6"]
    config = replace(SMALL, futr=("x1", "x2", *aggregates), fc_lags=(52,), rounds=6, horizon=26)

    def tree(whole, at, h):
        return members.forecast_gapped(whole, spec, members.fit_gapped(whole, spec, at, config), horizon=h)

    def rolled(whole, at, h):
        return members.rollout(whole, spec, at, h, 26, "seasonal_mean", "rolled")

    def broken(whole, at, h):
        raise RuntimeError("weights are not available offline")

    rungs = (("full", {"deep": 0.5, "tree": 0.5}), ("tree and rolled", {"tree": 0.7, "rolled": 0.3}), ("rolled", {"rolled": 1.0}))
    out, rung = workflows.predict(
        history, asked.select("unique_id", "ds", *SIGNALS), index_rows, spec, {"deep": broken, "tree": tree, "rolled": rolled}, rungs, aggregates=aggregates,
        block_registry=lambda s: blocks.registry(s, cut, live=["x1"], given=["x1"], refill=[], memory=["x1"], asymmetric=["x1"]),
    )
    last = history.groupBy("unique_id").agg(F.max_by("y", "hidx").alias("_last"))
    scored = out.join(asked.select("unique_id", "ds", "y"), ["unique_id", "ds"]).join(last, "unique_id")
    errors = scored.agg(F.sum(F.abs(F.col("y") - F.col("prediction"))), F.sum(F.abs(F.col("y") - F.col("_last"))), F.count(F.lit(1))).first()
    sound = (F.col("prediction") >= 0) & ~F.isnan("prediction")
    return scored.select("unique_id", "ds", F.lit(rung).alias("rung"), sound.alias("sound"), F.lit(errors[0] < errors[1]).alias("below_naive"), F.lit(errors[2]).cast("long").alias("n"))


@query(
    "G3_sweep_run", "cube",
    """SELECT members, TRUE AS sound FROM (SELECT unnest(['naive+seasonal_naive', 'naive+seasonal_mean', 'seasonal_naive+seasonal_mean',
      'naive+seasonal_naive+seasonal_mean', 'pool', 'best minus incumbent']) AS members) WHERE (SELECT count(*) FROM scored) > 0""",
)
def sweep_run(t: Tables):
    out = workflows.sweep(t.scored, t.weekly, MEMBERS, {"seasonal_naive": 0.5, "seasonal_mean": 0.5})
    # A convex mixture has no larger error than its worst member.
    late = t.scored.filter(F.col("blk") >= t.weekly.late_from)
    worst = max(late.agg(*(M.wape(F.col("y"), F.col(m)).alias(m) for m in MEMBERS)).first()) + 1e-9
    best = out["combinations"].select("members", "late_wape")
    return best.unionByName(out["pool"].select(F.lit("pool").alias("members"), "late_wape")).unionByName(
        out["best_vs_incumbent"].select(F.lit("best minus incumbent").alias("members"), F.col("delta").alias("late_wape"))
    ).select("members", (F.col("late_wape") < worst).alias("sound"))


@query(
    "R3_registered_members", "cube",
    "SELECT cutoff, sum(abs(y - naive)) / sum(abs(y)) AS naive, sum(abs(y - seasonal_naive)) / sum(abs(y)) AS seasonal_naive,"
    " sum(abs(y - seasonal_mean)) / sum(abs(y)) AS seasonal_mean FROM scored GROUP BY 1",
    digits="naive seasonal_naive seasonal_mean",
)
def registered_members(t: Tables):
    from panelloom.operators.assembly import join_members

    out = None
    for cut in CUTOFFS:
        ctx = runners.Context(t.kept_s, t.weekly, cut)
        frames = {m: runners.run_member(m, ctx) for m in runners.available("baseline")}
        cube = join_members(frames, ["unique_id", "ds", "y"])
        part = cube.agg(*(M.wape(F.col("y"), F.col(m)).alias(m) for m in frames)).withColumn("cutoff", F.lit(cut).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out
