from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from panelloom.operators import baselines, blend, members, origin
from panelloom.operators import design as D
from panelloom.operators.members import TreeConfig
from panelloom.spec import PanelSpec

SPEC = PanelSpec(signals=("x1",), statics=("capacity",), season=6, score_len=4, lags=(1, 2), rolls=(3,), series_len=60, train_end=50, late_from=2)
CONFIG = TreeConfig(rounds=3, depth=3, stride=6, futr=("x1",), statics=("capacity",))


@pytest.fixture(scope="module")
def panel(spark):
    return spark.range(12 * 60).selectExpr(
        "concat('u', lpad(cast(id div 60 as string), 2, '0')) AS unique_id", "timestamp_seconds((id % 60) * 86400) AS ds", "id % 60 AS hidx",
        "cast((id div 60) * 3 + (id % 6) * 2 + (id * 7919 % 13) / 13.0 AS double) AS y", "cast(id % 5 AS double) AS x1", "cast(1 + id div 60 AS double) AS capacity",
    ).cache()


def forecasts(spark, panel, config):
    return sorted((r.unique_id, r.step, r.tree) for r in members.forecast_gapped(panel, SPEC, members.fit_gapped(panel, SPEC, 50, config)).collect())


def test_trees_do_not_depend_on_the_session(spark, panel):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("4", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(forecasts(spark, panel.repartition(int(n) + 1), CONFIG))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert got[0] == got[1] and len(got[0]) == 12 * SPEC.full_horizon


def test_the_unit_is_a_category_of_any_size(spark, panel):
    config = replace(CONFIG, unit=True, leaves=8, features=1.0, subsample=1.0, bins=4)  # fewer bins than units
    member = members.fit_gapped(panel, SPEC, 50, config)
    place = member.features.index(D.UNIT)
    assert member.model.bins.category == place and member.model.bins.codes == 12 and member.model.bins.widths[place] == 0
    assert len(forecasts(spark, panel, config)) == 12 * SPEC.full_horizon


def test_losses_are_named(panel):
    with pytest.raises(ValueError):
        members.fit_gapped(panel, SPEC, 50, replace(CONFIG, loss="huber"))


def test_a_phase_never_seen_takes_the_median_past_one_season(panel):
    holes = panel.withColumn("y", F.when((F.col("hidx") % 6 != 2) | (F.col("hidx") >= 50) | (F.col("unique_id") != "u03"), F.col("y")))
    middle = holes.filter("hidx < 50").agg(F.percentile("y", F.lit(0.5))).first()[0]
    for spec in (SPEC, SPEC.with_(series_len=None)):
        cube = baselines.baseline_cube(holes, spec, [50], 8).filter("unique_id = 'u03' AND hidx % 6 = 2").collect()
        assert [r.seasonal_mean for r in cube] == [middle] * len(cube) and cube


def test_forecasters_see_the_whole_history(panel):
    seen = origin.forecast_blocks(panel, SPEC, [(50, 4)], lambda v, h: [float(len(v))] * h).select("channel").distinct().collect()
    assert [r.channel for r in seen] == [50.0]


def test_line_search_with_ties_and_bounds(spark):
    r, d = F.col("r"), F.col("d")
    cases = [([(0.3, 1.0)] * 30_000 + [(0.9, 1.0)] * 10, 0.3), ([(2.0, 1.0), (3.0, 1.0)], 1.0), ([(-1.0, 1.0)], 0.0), ([(0.0, 0.0)], 0.0), ([(0.2, 1.0), (0.8, 4.0)], 0.2)]
    for rows, want in cases:
        assert blend._steps_curve(spark.createDataFrame(rows, "r double, d double"), r, d, exact_below=2) == pytest.approx(want)
