"""Imputation: agreement with pandas, no reading of the future, refusals."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.operators import blocks, calendar, impute, index
from panelloom.spec import PanelSpec
from tests.fixtures import HOURLY, pull, random_panel, to_spark

SPEC = HOURLY.with_(series_len=21 * 24, train_end=336)
COLS = ["sig_a", "sig_b", "exact"]


@pytest.fixture(scope="module")
def panel(spark):
    pdf = random_panel()
    return pdf, to_spark(spark, pdf).cache()


def block_of(df, strategy, cut=336, n=100, poison=False):
    if poison:
        bad = F.when(F.col("hidx") >= cut, F.lit(1e9))
        df = df.withColumns({c: F.coalesce(bad, F.col(c)) for c in COLS})
    history, target = df.filter(F.col("hidx") < cut), index.gapped_horizon(df, SPEC, cut, n)
    out = impute.reconstruct_block(target, history, SPEC, COLS, F.lit(True), strategy=strategy)
    return pull(out.select("unique_id", "hidx", *COLS), "unique_id", "hidx")


@pytest.mark.parametrize("strategy", [s for s in impute.available(impute.GAP) if s != "frame"] + ["how168+exact+guard"])
def test_gap_fill_never_reads_the_block(panel, strategy):
    _, df = panel
    pd.testing.assert_frame_equal(block_of(df, strategy), block_of(df, strategy, poison=True))


@pytest.mark.parametrize("n", [1, 100, 168])
def test_profile_and_exact_match_pandas(panel, n):
    pdf, df = panel
    got = block_of(df, "how168+exact", n=n)
    hist = pdf[pdf.hidx < 336].copy()
    hist["how"] = hist.ds.dt.dayofweek * 24 + hist.ds.dt.hour
    tgt = pdf[(pdf.hidx >= 336) & (pdf.hidx < 336 + n)].copy()
    tgt["how"] = tgt.ds.dt.dayofweek * 24 + tgt.ds.dt.hour
    med = hist.groupby("unique_id").sig_a.median()
    prof = hist.groupby(["unique_id", "how"]).sig_a.median()
    want = [prof.get((u, h)) if pd.notna(prof.get((u, h))) else med[u] for u, h in zip(tgt.unique_id, tgt.how)]
    np.testing.assert_allclose(got.sig_a, want)
    # Two weeks of history give two observations per bin: too few to call a column exact.
    assert impute.exact_columns(df.filter("hidx < 336"), SPEC, COLS) == []
    assert impute.exact_columns(df, SPEC, COLS) == ["exact"]


def test_last_week_walks_back_on_a_long_gap(panel):
    pdf, df = panel
    out = block_of(df, "snaive168", cut=200, n=300)
    wide = pdf.set_index(["unique_id", "hidx"]).exact
    for _, r in out.iterrows():
        back = max((r.hidx - 199 + 167) // 168, 1) * 168 if r.hidx > 199 else 168
        src = r.hidx - back
        assert r.exact == wide[(r.unique_id, src)], r


def test_surfaces_and_modifiers_are_checked(panel):
    _, df = panel
    for bad in ("interp", "ffill"):
        with pytest.raises(ValueError):
            impute.resolve(bad, impute.GAP)
    with pytest.raises(ValueError):
        impute.resolve("how168_lvl", impute.SCATTERED)
    with pytest.raises(ValueError):
        impute.resolve("median+sharp", impute.GAP)
    with pytest.raises(KeyError):
        impute.resolve("spline", impute.GAP)
    with pytest.raises(ValueError):
        block_of(df, "frame")


def test_apply_fill_falls_back_to_the_pooled_median(spark):
    pdf = pd.DataFrame(
        {
            "unique_id": ["a", "a", "a", "b", "b"], "ds": pd.date_range("2023-01-01", periods=5, freq="h"), "hidx": [0, 1, 2, 0, 1],
            "x": [1.0, np.nan, 5.0, np.nan, np.nan],
        }
    )
    df, spec = to_spark(spark, pdf), PanelSpec(nullable=("x",), series_len=3)
    stats = impute.fit_fill_stats(df, spec)
    out = pull(impute.apply_fill(df, spec, stats), "unique_id", "hidx")
    assert out.x.tolist() == [1.0, 3.0, 5.0, 3.0, 3.0]
    assert out.x_missing.tolist() == [0, 1, 0, 1, 1]
    edge = pull(impute.fill_scattered(df, spec, ["x"], strategy="interp"), "unique_id", "hidx")
    assert edge.x.iloc[1] == 3.0 and edge.x.iloc[3:].isna().all()


def test_gap_length_is_derived():
    at = datetime(2023, 1, 1)
    assert impute.gap_length(at, datetime(2023, 1, 1, 1)) == 0
    assert impute.gap_length(at, datetime(2023, 1, 15, 1)) == 336
    with pytest.raises(ValueError):
        impute.gap_length(at, at)


def test_calendar_is_verified_before_use(panel):
    _, df = panel
    enc = df.withColumns(calendar.periodic_encodings(F.col("ds")))
    calendar.verify_periodic(enc, "ds")
    with pytest.raises(ValueError):
        calendar.verify_periodic(enc.withColumn("hour_sin", F.col("hour_sin") + 1e-6), "ds")
    with pytest.raises(ValueError):
        calendar.fit_trend(enc.withColumn("trend", F.col("hidx") * F.col("hidx")), "ds")
    with pytest.raises(ValueError):
        calendar.fit_trend(enc.filter("hidx = 0").withColumn("trend", F.lit(1.0)), "ds")
    line = calendar.fit_trend(enc.withColumn("trend", F.lit(1.25) + F.lit(0.0007) * F.col("hidx")), "ds")
    assert line.slope == pytest.approx(0.0007) and line.intercept == pytest.approx(1.25)


def test_scaling_round_trips_with_a_flat_series(spark):
    pdf = pd.DataFrame({"unique_id": ["a"] * 4 + ["flat"] * 4, "hidx": [0, 1, 2, 3] * 2, "y": [1.0, 2.0, 4.0, 9.0] + [7.0] * 4})
    df, spec = spark.createDataFrame(pdf), PanelSpec(series_len=4)
    table = impute.robust_scale_table(df, spec, ["y"])
    scaled = impute.robust_scale(df, table, spec, ["y"])
    assert scaled.filter("unique_id = 'flat' AND y <> 0").count() == 0
    back = pull(impute.robust_scale(scaled, table, spec, ["y"], inverse=True), "unique_id", "hidx")
    np.testing.assert_allclose(back.y, pdf.y)


def test_memory_spans_the_boundary_and_first_row_is_its_own(panel):
    pdf, df = panel
    out, names = blocks.backward_memory(df, SPEC, ["exact"], (6,))
    out = pull(out.select("unique_id", "hidx", *names), "unique_id", "hidx")
    want = pdf.groupby("unique_id").exact.transform(lambda s: s.ewm(halflife=6, adjust=False).mean().shift(1)).fillna(pdf.exact)
    np.testing.assert_allclose(out[names[0]], want)
    cut, _ = blocks.backward_memory(df.filter("hidx >= 336").withColumn("hidx", F.col("hidx") - 336), SPEC, ["exact"], (6,))
    alone = pull(cut.select("unique_id", "hidx", *names), "unique_id", "hidx")
    assert not np.allclose(alone[names[0]], out[out.hidx >= 336][names[0]])


@pytest.mark.parametrize("fitted", ["C2", "A14"])
def test_fitted_blocks_ignore_everything_after_the_cut(panel, fitted):
    _, df = panel
    kinds = dict(live=["exact"], given=["exact"], refill=[], memory=["exact"], asymmetric=["exact"])
    flagged = impute.add_indicators(df, SPEC.nullable)
    made = blocks.registry(SPEC, 336, **kinds)[fitted]
    poisoned = flagged.withColumn("y", F.when(F.col("hidx") >= 336, F.lit(1e9)).otherwise(F.col("y")))
    a, names = made.build(flagged)
    b, _ = made.build(poisoned)
    assert set(names) == set(made.names)
    cols = ["unique_id", "hidx", *names]
    pd.testing.assert_frame_equal(pull(a.select(*cols), "unique_id", "hidx"), pull(b.select(*cols), "unique_id", "hidx"))


def test_attach_refuses_ragged_and_missing(panel):
    _, df = panel
    kinds = dict(live=["sig_a"], given=["exact"], refill=[], memory=["exact"], asymmetric=["exact"])
    made = blocks.registry(SPEC, 336, **kinds)
    assert blocks.attach_aggregates(df, SPEC, ["y"], made) is df
    with pytest.raises(ValueError, match="rectangle"):
        blocks.attach_aggregates(df.filter("NOT (unique_id = 'u1' AND hidx = 9)"), SPEC, ["xs_sys_exact"], made)
    with pytest.raises(ValueError, match="missing"):
        blocks.attach_aggregates(df, SPEC, ["xs_cap_sig_a"], made)
    with pytest.raises(ValueError, match="no rebuildable"):
        blocks.attach_aggregates(df, SPEC, ["clim_how"], made)


def test_components_match_svd_and_groups_follow_correlation(spark):
    rng = np.random.default_rng(2)
    n, t = 12, 120
    base = [rng.normal(0, 1, t) for _ in range(2)]
    x = np.array([3 * base[s % 2] + 0.2 * rng.normal(0, 1, t) + s for s in range(n)])
    pdf = pd.DataFrame(
        {"unique_id": np.repeat([f"u{s:02d}" for s in range(n)], t), "hidx": np.tile(np.arange(t), n), "x": x.ravel(), "y": x.ravel()}
    )
    df, spec = spark.createDataFrame(pdf), PanelSpec(series_len=t)
    out, names = blocks.principal_components(df, spec, ["x"], 100, 2)
    got = pull(out.filter("unique_id = 'u00'").select("hidx", *names), "hidx")
    mu = x[:, :100].mean(axis=1, keepdims=True)
    _, _, v = np.linalg.svd((x[:, :100] - mu).T, full_matrices=False)
    want = (x - mu).T @ v[:2].T
    for j, name in enumerate(names):
        assert abs(np.corrcoef(got[name], want[:, j])[0, 1]) == pytest.approx(1, abs=1e-6)
        np.testing.assert_allclose(np.abs(got[name]), np.abs(want[:, j]), atol=1e-6)
    groups = pull(blocks.learned_groups(df, spec, 100, k=2), "unique_id").cluster.tolist()
    assert groups == [0, 1] * (n // 2)
