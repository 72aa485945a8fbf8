"""Rolling-origin design and baselines on panels whose lags can be read from their values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.operators import baselines, design, index, origin
from panelloom.spec import PanelSpec
from tests.fixtures import identity_panel, pull

SPEC = PanelSpec(season=6, score_len=6, train_end=48, late_from=4, lags=(1, 3), rolls=(4,), series_len=60)


@pytest.fixture(scope="module")
def panel(spark):
    return identity_panel(spark).cache()


def test_lags_read_what_they_name(panel):
    pairs = design.training_pairs(panel, SPEC, 48, 12, 5)
    out = design.build_design(panel, pairs, SPEC, futr=["x"], statics=["capacity"], fc_lags=(12, 18), unit=True, horizon=12).toPandas()
    base = out.unit_id * 1000
    assert (out.o + out.k < 48).all() and out.o.min() > 0
    assert (out.lag_1 == out.o + base).all()
    assert (out.lag_3.dropna() == (out.o - 2 + base)[out.lag_3.notna()]).all()
    assert (out.y == out.o + out.k + base).all() and (out.x == out.o + out.k).all()
    assert (out.wlag_12.dropna() == (out.o + out.k - 12 + base)[out.wlag_12.notna()]).all()
    assert (out.wlag_12.dropna() <= (out.o + base)[out.wlag_12.notna()]).all()
    full = out.o >= 3
    assert np.allclose(out.roll_4[full], (out.o - 1.5 + base)[full])


def test_training_design_equals_the_general_one(panel):
    kw = dict(futr=["x"], statics=["capacity"], fc_lags=(12,), unit=True, horizon=12)
    a = design.build_design(panel, design.training_pairs(panel, SPEC, 48, 12, 5), SPEC, **kw)
    b = design.training_design(panel, SPEC, 48, stride=5, **kw)
    pd.testing.assert_frame_equal(pull(a, "unique_id", "o", "k"), pull(b, "unique_id", "o", "k"))


def test_design_does_not_see_the_future(panel):
    poisoned = panel.withColumn("y", F.when(F.col("hidx") >= 48, F.lit(1e9)).otherwise(F.col("y")))
    kw = dict(fc_lags=(12,), target=False, horizon=12)
    pairs = design.inference_pairs(panel, SPEC, 48, 12)
    a, b = (pull(design.build_design(p, pairs, SPEC, **kw), "unique_id", "o", "k") for p in (panel, poisoned))
    pd.testing.assert_frame_equal(a, b)
    assert len(a) == 24


def test_short_forecast_lags_are_refused():
    for bad in ((6,), (12, 12)):
        with pytest.raises(ValueError):
            design.check_forecast_lags(bad, 12)


def test_early_stopping_fold_is_inside_train(panel):
    train, valid = design.early_stopping_pairs(panel, SPEC, 48, 12, 6, 5)
    t, v = train.toPandas(), valid.toPandas()
    assert (t.o + t.k).max() == 41 and (v.o + v.k).min() == 42 and (v.o + v.k).max() == 47 and set(v.o) == {35}


def test_one_pass_cube_equals_the_joined_one(panel):
    cuts = [48, 42, 30]
    one = baselines.baseline_cube(panel, SPEC, cuts, 12)
    joined = baselines.baseline_cube(panel, SPEC.with_(series_len=None), cuts, 12)
    cols = ["cutoff", "unique_id", "step", "blk", "y", "naive", "seasonal_naive", "seasonal_mean"]
    a, b = (pull(d.select(*cols), "cutoff", "unique_id", "step") for d in (one, joined))
    pd.testing.assert_frame_equal(a, b)
    first = a[(a.cutoff == 48) & (a.unique_id == "u0")]
    assert first.naive.unique().tolist() == [47.0]
    assert first.seasonal_naive.tolist() == [42, 43, 44, 45, 46, 47] * 2


def test_windows_are_half_open_and_disjoint(panel):
    rows = index.horizons(panel, SPEC, [48, 42, 36], 12).toPandas()
    assert (rows.groupby(["cutoff", "unique_id"]).size() == 12).all()
    assert ((rows.hidx >= rows.cutoff) & (rows.hidx < rows.cutoff + 12)).all()
    assert index.gapped_horizon(panel, SPEC, 36, 12).count() == 24


def test_regimes_partition_and_refuse(panel):
    cube = baselines.baseline_cube(panel, SPEC, [48, 42], 12)
    near, far = (index.select_horizon(cube, SPEC, h) for h in ("near", "far"))
    assert near.count() + far.count() == cube.count()
    assert near.join(far, ["cutoff", "unique_id", "step"]).count() == 0
    with pytest.raises(ValueError):
        index.select_regime(cube, SPEC, "early")
    with pytest.raises(KeyError):
        index.select_horizon(cube.drop("step"), SPEC, "near")
    for mode in ("gapped-withheld", "contiguous"):
        with pytest.raises(ValueError):
            index.check_mode(mode, "near")
    with pytest.raises(ValueError):
        index.trim_to_patches(panel, SPEC, 64)


def test_ragged_series_split_on_their_own_tails(panel):
    ragged = panel.filter("unique_id = 'u0' OR hidx < 50").drop("hidx")
    out = index.gapped_split(ragged, SPEC, 6).toPandas()
    sizes = out.groupby(["unique_id", "part"]).size().unstack()
    assert sizes.gap.tolist() == [6, 6] and sizes.score.tolist() == [6, 6] and sizes.train.tolist() == [48, 38]
    with pytest.raises(ValueError):
        index.gapped_split(panel.filter("hidx < 24").drop("hidx"), SPEC, 6)
    short = index.gapped_split(panel.filter("hidx < 24").drop("hidx"), SPEC, 6, shrink=True).toPandas()
    assert (short.groupby(["unique_id", "part"]).size().unstack()[["gap", "score"]] == 4).all().all()


def test_blocks_are_honest_and_splice_only_the_stale(panel):
    frame, blocks = origin.roll_train(panel, SPEC, 60, 12)
    pdf = frame.toPandas()
    assert blocks == [(48, 12), (36, 12), (24, 12), (12, 12)]
    assert (pdf.channel < pdf.cutoff + 1000 * (pdf.unique_id == "u1")).all()
    assert origin.stale_range(blocks, 48, 12, 60) == (60, 60)
    assert origin.stale_range(blocks, 42, 12, 60) == (48, 54)
    asked = []

    def fresh(cut, h):
        asked.append(cut)
        return origin.forecast_horizon(panel, SPEC, cut, h)[0]

    out, kept = origin.rehost(frame, SPEC, blocks, 42, 12, 60, "channel", fresh)
    late = out.filter("hidx >= 48 AND hidx < 54 AND unique_id = 'u0'").orderBy("hidx").toPandas()
    assert late.channel.tolist() == [36, 37, 38, 39, 40, 41] and kept[-1] == (42, 12)
    same, kept = origin.rehost(frame, SPEC, blocks, 48, 12, 60, "channel", fresh)
    assert same is frame and asked == [42] and (48, 12) in kept


def test_python_forecaster_gets_only_its_context(panel):
    def peek(values, h):
        assert len(values) <= 10 and not np.isnan(values).any()
        return np.full(h, values.max())

    out = origin.forecast_blocks(panel, SPEC, [(30, 6), (48, 12)], peek, context_rows=10).toPandas()
    u0 = out[out.unique_id == "u0"]
    assert set(u0[u0.cutoff == 30].channel) == {29.0} and set(u0[u0.cutoff == 48].channel) == {47.0}
    assert out.groupby(["unique_id", "cutoff"]).size().tolist() == [6, 12] * 2
    with pytest.raises(Exception, match="shape"):
        origin.forecast_blocks(panel, SPEC, [(30, 6)], lambda v, h: np.zeros(h + 1), context_rows=10).collect()
