"""Files, stores, the retail panel, fitted members and the driver contract."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelloom.operators import evaluate, impute, members
from panelloom.plans import workflows
from panelloom.session import shared_folder
from panelloom.sources import cubes, panel_files, retail
from panelloom.spec import PanelSpec
from tests.check_oracle import compare, connect
from tests.fixtures import pull

SF = "/root/testdata/sf0.001"


def test_csv_nan_is_null_and_flags_survive(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text("series_id,timestamp,target,x\nu1,2023-01-01 00:00:00,1.5,NaN\nu1,2023-01-01 01:00:00,2.5,\nu1,2023-01-01 02:00:00,3.5,4.0\n")
    spec = PanelSpec(nullable=("x",), series_len=3)
    long, stats = panel_files.load_long(spark, str(path), panel_files.schema(["x"]), spec)
    out = pull(long, "ds")
    assert out.x.tolist() == [4.0, 4.0, 4.0] and out.x_missing.tolist() == [1, 1, 0] and stats.overall == {"x": 4.0}


def test_index_files_prefer_known_names(spark, tmp_path):
    for name, row in (("forecast_index_zz.csv", "b"), ("forecast_index_aa.csv", "a")):
        (tmp_path / name).write_text(f"series_id,timestamp\n{row},2023-01-01 00:00:00\n")
    assert panel_files.load_forecast_index(spark, str(tmp_path)).first()["series_id"] == "a"
    (tmp_path / "forecast_index_validation.csv").write_text("series_id,timestamp\nv,2023-01-01 00:00:00\n")
    assert panel_files.load_forecast_index(spark, str(tmp_path)).first()["series_id"] == "v"
    assert panel_files.load_covariates(spark, str(tmp_path), ["x"]) is None
    with pytest.raises(FileNotFoundError):
        panel_files.load_forecast_index(spark, str(tmp_path / "nowhere"))


def test_predictions_are_matched_by_key_and_kept_in_order(spark):
    keys = ["unique_id", "ds"]
    n = 50
    order = np.random.default_rng(0).permutation(n)
    index = spark.createDataFrame(pd.DataFrame({"unique_id": "u", "ds": pd.to_datetime("2023-01-01") + pd.to_timedelta(order, unit="h"), "_order": np.arange(n)}))
    preds = spark.range(n).select(F.lit("u").alias("unique_id"), F.timestamp_seconds(F.lit(1_672_531_200) + F.col("id") * 3600).alias("ds"), F.col("id").cast("double").alias("p"))
    out = panel_files.assign_predictions(index, preds.repartition(7), keys, "p").orderBy("_order").toPandas()
    assert out.p.tolist() == order.tolist()
    with pytest.raises(ValueError, match="duplicate"):
        panel_files.assign_predictions(index, preds.unionByName(preds.limit(1)), keys, "p")
    with pytest.raises(ValueError, match="got no prediction"):
        panel_files.assign_predictions(index, preds.filter("p > 3"), keys, "p")
    path = f"{shared_folder(spark)}/order-test"
    panel_files.write_predictions(panel_files.assign_predictions(index, preds, keys, "p"), path, keys, "p", "_order", one_file=True)
    back = spark.read.csv(path, header=True, inferSchema=True).toPandas()
    assert back.p.tolist() == order.tolist() and list(back.columns) == [*keys, "p"]


def test_cube_store_refuses_on_any_doubt(spark, tmp_path):
    cube = spark.range(5).select(F.col("id").alias("k"), F.col("id").cast("double").alias("m"))
    key = cubes.cache_key("m", train_identity=cubes.frame_identity(cube), cutoffs=[1], seed=None, config={}, code="1")
    root = str(tmp_path)
    assert cubes.cache_key("m", train_identity="", cutoffs=[1], seed=None, config=None, code="1") is None
    assert cubes.load(spark, root, "m", key) is None
    cubes.store(cube, root, "m", key)
    assert cubes.load(spark, root, "m", key).count() == 5
    for change in ({"nan_fill": "interp"}, {"gap_fill": "how168"}, {"gap_cov": "real"}, {"seed": 1}):
        assert cubes.load(spark, root, "m", {**key, **change}) is None
    cubes.store(cube.withColumn("m", F.when(F.col("k") > 0, F.col("m"))), root, "m", key)
    assert cubes.load(spark, root, "m", key) is None
    assert cubes.frame_identity(cube) == cubes.frame_identity(cube.repartition(3)) != cubes.frame_identity(cube.limit(4))


@pytest.fixture(scope="module")
def shop(spark):
    """Eight shops over 300 days: a level each, a weekday pattern, a promotion every tenth day, a price in steps."""
    day, shop_no = F.col("id") % 300, F.floor(F.col("id") / 300)
    date = F.date_add(F.lit("2020-01-01").cast("date"), day.cast("int"))
    weekday = F.get(F.array(*map(F.lit, (3.0, 1.0, 4.0, 1.5, 5.0, 2.0, 0.5))), F.weekday(date))
    promo, wobble = (day % 10 == 0).cast("double"), (F.col("id") * 7919 % 101) / 101.0
    panel = spark.range(8 * 300).select(
        F.concat(F.lit("shop_"), F.lpad(shop_no.cast("string"), 3, "0")).alias("unique_id"), date.cast("timestamp").alias("ds"), day.alias("hidx"),
        (weekday + 2 * promo + shop_no / 2 + wobble).alias("y"), (F.lit(1.0) + F.floor(day / 20) / 10).alias("sell_price"),
        promo.alias("snap_CA"), (1 - promo).alias("snap_TX"), promo.alias("snap_WI"), F.weekday(date).cast("double").alias("wday"),
        F.month(date).cast("double").alias("month"), (F.weekday(date) >= 5).cast("double").alias("is_weekend"), (day % 50 == 3).cast("double").alias("event_active"),
    )
    statics = spark.range(8).select(F.concat(F.lit("shop_"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("unique_id"), *(
        (F.col("id") % n).alias(c) for c, n in (("item_id", 8), ("dept_id", 3), ("cat_id", 2), ("store_id", 4), ("state_id", 3))
    ))
    return panel.cache(), statics


@pytest.mark.parametrize("n", [3, 17, 40, 100])
def test_quota_is_proportional_by_largest_remainder(spark, n):
    sizes = {("a", "x"): 23, ("a", "y"): 5, ("b", "x"): 11, ("b", "y"): 1}
    rows = [(f"{d}{s}{i}", d, s) for (d, s), k in sizes.items() for i in range(k)]
    statics = spark.createDataFrame(rows, "unique_id string, dept_id string, store_id string")
    got = {(r.dept_id, r.store_id): r.take for r in retail.stratum_quota(statics, n).collect()}
    total = sum(sizes.values())
    if n >= total:
        assert got == sizes
    else:
        share = {k: v * n / total for k, v in sizes.items()}
        want = {k: int(v) for k, v in share.items()}
        for k in sorted(share, key=lambda k: (-(round(share[k] - want[k], 9)), k))[: n - sum(want.values())]:
            want[k] += 1
        assert got == want
    ids = retail.stratified_ids(statics, PanelSpec(), n).toPandas().unique_id
    assert len(ids) == min(n, total) and ids.is_unique


def test_retail_load_carries_within_series(spark, shop):
    panel, statics = shop
    root = f"{shared_folder(spark)}/retail-test"
    holes = panel.withColumn("sell_price", F.when((F.col("hidx") % 5 == 0) & (F.col("unique_id") != "shop_001"), F.col("sell_price")))
    holes.drop("hidx").write.mode("overwrite").parquet(f"{root}/panel")
    named = statics.withColumn("store_id", F.concat(F.lit("S"), F.col("store_id").cast("string")))
    named.write.mode("overwrite").parquet(f"{root}/statics")
    out, codes = retail.load(spark, f"{root}/panel", f"{root}/statics", retail.SPEC.with_(series_len=300))
    pdf = pull(out, "unique_id", "hidx")
    assert (pdf[pdf.unique_id == "shop_001"].sell_price == 0).all() and pdf.sell_price.notna().all()
    one = pdf[pdf.unique_id == "shop_002"]
    src = pull(panel.filter("unique_id = 'shop_002'"), "hidx")
    np.testing.assert_allclose(one.sell_price, src.sell_price.where(src.hidx % 5 == 0).ffill())
    assert sorted(r.store_id for r in codes.select("store_id").distinct().collect()) == [0, 1, 2, 3]


def test_tree_members_learn_the_season(spark, shop):
    panel, _ = shop
    spec = retail.SPEC.with_(series_len=300, score_len=14, lags=(1, 7, 14), rolls=(7,))
    config = members.TreeConfig(rounds=8, depth=4, stride=14, futr=("wday", "snap_CA"), fc_lags=(28,), step=0.3, min_rows=5)
    out = members.predict_gapped(panel, spec, 272, config).cache()
    assert out.count() == 8 * 14 and out.filter("tree < 0 OR y IS NULL").count() == 0
    scores = evaluate.panel_metrics(out, spec, ["tree"]).first()["wape"]
    flat = out.withColumn("flat", F.avg("y").over(Window.partitionBy("unique_id")))
    assert scores < evaluate.panel_metrics(flat, spec, ["flat"]).first()["wape"]
    poisoned = panel.withColumn("y", F.when(F.col("hidx") >= 272, F.lit(1e6)).otherwise(F.col("y")))
    again = members.predict_gapped(poisoned, spec, 272, config)
    a, b = (pull(d.select("unique_id", "ds", "tree"), "unique_id", "ds") for d in (out, again))
    pd.testing.assert_frame_equal(a, b)


def test_run_panel_records_failures(spark, shop):
    panel, _ = shop
    spec = retail.SPEC.with_(series_len=300, score_len=14)
    broken = panel.withColumn("y", F.col("y"))
    bad = members.TreeConfig(rounds=1, futr=("no_such_column",))
    out = workflows.run_panel(broken, spec, bad, ("naive", "seasonal_naive", "seasonal_mean", "tree", "other")).toPandas().set_index("arm")
    assert out.loc["tree", "status"] == "error" and out.loc["other", "status"] == "unknown arm"
    assert out.loc["seasonal_naive", "skill"] == 0 and out.loc["seasonal_mean", "skill"] > 0
    assert "blend" not in out.index


def test_statistics_are_fitted_before_the_cut(shop):
    panel, _ = shop
    spec = PanelSpec(nullable=("x",), series_len=300)
    df = panel.withColumn("x", F.when(F.col("hidx") % 3 > 0, F.col("y")))
    late = df.withColumn("x", F.when(F.col("hidx") < 200, F.col("x")).otherwise(F.col("x") * 100))
    a, b = (panel_files.load_window_long(d, spec, 200).filter("hidx < 200 AND hidx % 3 = 0") for d in (df, late))
    cols = ["unique_id", "hidx", "x"]
    pd.testing.assert_frame_equal(pull(a.select(*cols), *cols[:2]), pull(b.select(*cols), *cols[:2]))
    assert impute.fit_fill_stats(df, spec).per_series.count() == 8


SAMPLE = ["P1_hour_index", "W5_backward_ewma", "I4_hour_of_week", "I20_build_future", "X4_A4_shares_ranks", "X9_A9_capacity_weighted",
          "D7_build_design", "M6_pooled_wape", "E4_bootstrap_draws", "G1_pair_report", "V4_frame_audit", "H10_zone_correlation"]


@pytest.mark.parametrize("name", SAMPLE)
def test_registered_query_agrees_with_sql(spark, name):
    from __spark_entry__ import oracle_sql, queries

    got = queries()[name](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(oracle_sql()[name]).df()) == ""


def test_entry_runs(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 12


def test_ragged_panels_are_refused(shop):
    panel, _ = shop
    ragged = panel.filter("unique_id <> 'shop_003' OR hidx < 290")
    with pytest.raises(ValueError, match="end"):
        workflows.run_panel(ragged, retail.SPEC.with_(series_len=300, score_len=14), members.TreeConfig(), ("naive",))


def test_index_keeps_the_order_of_its_files(spark):
    """Several files, split into many partitions: the order is that of paths, places in the file and rows."""
    root = f"{shared_folder(spark)}/order-test"
    rows = [(f"u{i * 7919 % 1000:04d}", i) for i in range(1_000)]
    for part in range(3):
        mine = spark.createDataFrame(rows[part * 300 : (part + 1) * 300 + 100 * (part == 2)], "k string, i long").coalesce(1)
        mine.write.mode("overwrite").csv(f"{root}/part={part}")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
        got = panel_files.with_order(spark.read.schema("k string, i long").csv(root)).orderBy("_order").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert [r.i for r in got] == list(range(1_000)) and [r._order for r in got] == list(range(1_000))


def under_broadcast(df):
    """The lines of the plan that ran below a broadcast exchange."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [len(x) - len(x.lstrip(" :+-|*()0123456789")) for x in lines]
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out += lines[i + 1 : below]
    return out


def test_unrolled_calendar_is_never_broadcast(spark, tmp_path):
    """A filter on what was seen makes the panel's join an inner one, whose unrolled side looks as small as its keys."""
    from panelloom.plans.tables import Tables

    folder = str(tmp_path)
    spark.range(3).selectExpr("cast(id as int) n_nationkey", "cast(id as int) n_regionkey").write.parquet(f"{folder}/nation.parquet")
    spark.range(40).selectExpr("id s_suppkey", "cast(id % 3 as int) s_nationkey", "1.0d * id s_acctbal").write.parquet(f"{folder}/supplier.parquet")
    spark.range(20_000).selectExpr(
        "id % 40 l_suppkey", "timestamp'1995-01-02' + make_interval(0, 0, id % 30) l_shipdate", "1.0d l_quantity", "0.05d l_discount", "0.01d l_tax", "9.0d l_extendedprice",
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(20_000).selectExpr(
        "id event_id", "id % 50 user_id", "timestamp'1995-01-02' + make_interval(0, 0, 0, 0, id % 90) ts", "'a' event_type", "1.0d value",
    ).write.parquet(f"{folder}/events.parquet")
    t = Tables(spark, folder)
    for panel, rows in ((t.panel_s, 40 * 30), (t.panel_u, 50 * 90)):
        assert panel.count() == rows
        plan = under_broadcast(panel.filter("x1 IS NOT NULL"))
        assert not [x for x in plan if "Generate" in x]


def test_calendar_alone_counts_for_its_cells(spark, tmp_path):
    """Where nothing of what was seen is read, its join is dropped with its hint, and the cells are joined as they are."""
    from panelloom.plans.tables import Tables

    folder = str(tmp_path)
    spark.range(3).selectExpr("cast(id as int) n_nationkey", "cast(id as int) n_regionkey").write.parquet(f"{folder}/nation.parquet")
    spark.range(40).selectExpr("id s_suppkey", "cast(id % 3 as int) s_nationkey", "1.0d * id s_acctbal").write.parquet(f"{folder}/supplier.parquet")
    spark.range(2_000).selectExpr(
        "id % 40 l_suppkey", "timestamp'1995-01-02' + make_interval(0, 0, id % 300) l_shipdate", "1.0d l_quantity", "0.05d l_discount", "0.01d l_tax", "9.0d l_extendedprice",
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(2_000).selectExpr(
        "id event_id", "id % 50 user_id", "timestamp'1995-01-02' + make_interval(0, 0, 0, 0, id % 300) ts", "'a' event_type", "1.0d value",
    ).write.parquet(f"{folder}/events.parquet")
    t = Tables(spark, folder)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40000")  # above the keys, below their cells
    try:
        for panel, keys in ((t.panel_s, 40), (t.panel_u, 50)):
            cells = panel.select("unique_id", "hidx")
            joined = cells.join(panel.select("unique_id", "hidx", "ds"), ["unique_id", "hidx"])
            assert not [x for x in under_broadcast(joined) if "Generate" in x or "NestedLoop" in x]
            assert joined.count() == keys * 300 and joined.distinct().count() == keys * 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
