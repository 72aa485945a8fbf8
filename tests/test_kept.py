"""Work that is read more than once is done once; draws made in tasks are the digests an engine can repeat."""

import hashlib
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from panelloom.functions import digests, quantiles
from panelloom.operators.assembly import join_members, with_labels
from panelloom.plans.catalog import block_queries, source_queries
from panelloom.plans.tables import Tables
from panelloom.spec import PanelSpec


def counted(spark, rows, name):
    """``rows`` with a column ``name`` whose every evaluation is counted."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(x):
        seen.add(1)
        return float(x)

    return rows.withColumn(name, value("x")), seen


def test_members_are_evaluated_once_for_check_and_result(spark):
    rows = spark.createDataFrame([(i % 3, i, float(i)) for i in range(30)], "unique_id long, ds long, x double")
    member, seen = counted(spark, rows, "m")
    got = join_members({"m": member, "x": rows}, ["unique_id", "ds"])
    assert sorted((r.m, r.x) for r in got.collect()) == [(float(i), float(i)) for i in range(30)]
    assert seen.value == 30


def test_labelled_rows_are_evaluated_once_for_check_and_result(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(20)], "unique_id string, ds long, x double")
    preds, seen = counted(spark, rows, "p")
    labels = rows.withColumn("y", F.col("x") * 2)
    got = with_labels(preds.select("unique_id", "ds", "p"), labels, PanelSpec())
    assert sorted((r.p, r.y) for r in got.collect()) == [(float(i), 2.0 * i) for i in range(20)]
    assert seen.value == 20


def small_tables(spark, folder):
    day = date(1992, 1, 6)
    lines = [(s, float(1 + (s * i) % 7), 0.01 * (i % 5), 0.02 * (s % 3), 100.0 + i, day + timedelta(days=7 * i)) for s in (1, 2, 3) for i in range(0, 345, s + 1)]
    cols = "l_suppkey long, l_quantity double, l_discount double, l_tax double, l_extendedprice double, l_shipdate date"
    spark.createDataFrame(lines, cols).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(s, s % 2, 10.0 * s) for s in (1, 2, 3)], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(0, 0), (1, 1)], "n_nationkey long, n_regionkey long").write.parquet(f"{folder}/nation.parquet")
    return Tables(spark, str(folder))


def test_imputed_panels_read_the_kept_panel_not_the_facts(spark, tmp_path):
    t = small_tables(spark, tmp_path)
    columns = sorted(t.panel_s.columns)
    order = ["unique_id", "hidx"]
    assert t.kept_s.select(columns).orderBy(order).collect() == t.panel_s.select(columns).orderBy(order).collect()
    for rows in (block_queries.full(t), source_queries.filled(t), t.cube):
        assert not any("lineitem" in f for f in rows.inputFiles())


def test_pooled_quantiles_of_nulls_ties_and_infinities(spark):
    rng = np.random.default_rng(3)
    a = [None if i % 7 == 0 else float(x) for i, x in enumerate(rng.normal(size=20_000))]
    b = [float(i % 3) for i in range(20_000)]
    b[0] = float("inf")
    rows = spark.createDataFrame(list(zip(a, b, [None] * 20_000)), "a double, b double, c double")
    got = quantiles.pooled_many(rows, {"a1": ("a", 0.1), "a5": ("a", 0.5), "b5": ("b", 0.5), "none": ("c", 0.5)})
    known = np.array([x for x in a if x is not None])
    assert np.isclose(got["a1"], np.quantile(known, 0.1), rtol=1e-12) and np.isclose(got["a5"], np.median(known), rtol=1e-12)
    assert got["b5"] == 1.0 and got["none"] is None


def test_draws_are_the_digests_of_their_keys():
    rng = np.random.default_rng(5)
    rep = np.concatenate([rng.integers(0, 4_000, 20_000), rng.integers(0, 10**12, 200)])
    slot = np.concatenate([[0, 9, 10, 99, 100, 999_999_999, 10**9, 10**10 - 1], rng.integers(0, 10**6, 20_092), rng.integers(0, 10**12, 100)])
    for seed in (0, 17, -(2**40)):
        want = [int(hashlib.md5(f"{seed}:{r}:{s}".encode()).hexdigest()[:8], 16) % 777 for r, s in zip(rep, slot)]
        assert digests.drawn(seed, rep, slot, 777).tolist() == want


def test_the_design_of_the_trees_is_removed_when_they_are_grown(spark, monkeypatch):
    import os

    from panelloom.operators import members

    rows = spark.range(400).selectExpr("concat('u', id % 5) AS unique_id", "id AS o", "1L AS k", "id % 7 AS x", "cast(id % 7 AS double) AS y", "1.0D AS weight")
    seen, fit = [], members.boosting.fit

    def watched(kept, *given, **named):
        seen.append((kept.kept_at.removeprefix("file:"), os.path.isdir(kept.kept_at.removeprefix("file:"))))
        return fit(kept, *given, **named)

    monkeypatch.setattr(members.boosting, "fit", watched)
    forest = members._fit_rows(rows, PanelSpec(signals=("x",)), ["x"], members.TreeConfig(loss="squared"), 2)
    assert len(forest.trees) == 2
    assert [there for _, there in seen] == [True] and not os.path.exists(seen[0][0])
