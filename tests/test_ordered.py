"""Chunked computation equals plain windows, whatever the chunk length, and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions import ordered, quantiles
from panelloom.spec import PanelSpec
from tests.fixtures import pull, random_panel, to_spark

WHOLE = PanelSpec(series_len=400)
KEYS = ("unique_id", "hidx")


@pytest.fixture(scope="module")
def panel(spark):
    pdf = random_panel(3, 400, holes=0.3)
    df = to_spark(spark, pdf[["unique_id", "ds", "hidx", "y", "sig_a"]]).repartition(5, "hidx").cache()
    return pdf, df


@pytest.mark.parametrize("chunk", [7, 64, 1000])
def test_row_index_is_chunk_free(panel, chunk):
    _, df = panel
    seen = df.filter("sig_a IS NOT NULL").select("unique_id", "ds")
    a = pull(ordered.row_index(seen, WHOLE), "unique_id", "ds")
    b = pull(ordered.row_index(seen, PanelSpec(chunk_rows=chunk)), "unique_id", "ds")
    pd.testing.assert_frame_equal(a, b[a.columns])
    assert a.groupby("unique_id").hidx.apply(lambda s: (s.diff().dropna() == 1).all()).all()


@pytest.mark.parametrize("chunk", [60, 130])
def test_lags_and_means_match_pandas(panel, chunk):
    pdf, df = panel
    y = F.col("sig_a")
    for spec in (WHOLE, PanelSpec(chunk_rows=chunk)):
        out = ordered.lagged(df, spec, {"l": (y, 13), "f": (y, -5)})
        out = ordered.rolling_mean(out, spec, {"t5": (y, 5), "t168": (y, 168)}, centred=False)
        out = pull(ordered.rolling_mean(out, spec, {"c6": (y, 6), "c72": (y, 72)}, centred=True), *KEYS)
        g = pdf.sort_values(list(KEYS)).groupby("unique_id").sig_a
        want = {
            "l": g.shift(13), "f": g.shift(-5),
            **{f"t{n}": g.transform(lambda s, n=n: s.rolling(n, min_periods=1).mean()) for n in (5, 168)},
            **{f"c{n}": g.transform(lambda s, n=n: s.rolling(n, center=True, min_periods=1).mean()) for n in (6, 72)},
        }
        for name, w in want.items():
            np.testing.assert_allclose(out[name].to_numpy(float), w.to_numpy(float), rtol=1e-9, err_msg=name)


@pytest.mark.parametrize("chunk", [9, 100])
def test_fills_and_interpolation_match_pandas(panel, chunk):
    pdf, df = panel
    g = pdf.sort_values(list(KEYS)).groupby("unique_id").sig_a
    for spec in (WHOLE, PanelSpec(chunk_rows=chunk)):
        out = ordered.carried(df, spec, {"ff": F.col("sig_a")})
        out = ordered.carried(out, spec, {"bf": F.col("sig_a")}, backward=True)
        out = pull(ordered.interpolated(out, spec, {"ip": F.col("sig_a")}), *KEYS)
        np.testing.assert_allclose(out.ff.to_numpy(float), g.ffill().to_numpy())
        np.testing.assert_allclose(out.bf.to_numpy(float), g.bfill().to_numpy())
        want = g.transform(lambda s: s.interpolate(limit_area="inside"))
        np.testing.assert_allclose(out.ip.to_numpy(float), want.to_numpy(), rtol=1e-12)


def test_ewma_matches_pandas_over_many_half_lives(spark):
    n = 3000
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"unique_id": "a", "hidx": np.arange(n), "x": rng.normal(5, 2, n)})
    df = spark.createDataFrame(pdf)
    for spec in (PanelSpec(series_len=n), PanelSpec(chunk_rows=50)):
        out = pull(ordered.ewma(df, spec, {"h1": (F.col("x"), 1.0), "h48": (F.col("x"), 48.0)}), "hidx")
        for h in (1, 48):  # 3,000 half-lives for the first: a single prefix sum would overflow
            want = pdf.x.ewm(halflife=h, adjust=False).mean()
            np.testing.assert_allclose(out[f"h{h}"], want, rtol=1e-9)


def test_hot_series_is_spread_over_chunks(spark):
    """A series with half of all rows occupies many window partitions."""
    hot = spark.range(5000).select(F.lit("hot").alias("unique_id"), F.col("id").alias("hidx"), F.col("id").cast("double").alias("y"))
    cold = spark.range(5000).select(
        F.concat(F.lit("c"), F.pmod("id", F.lit(100)).cast("string")).alias("unique_id"),
        F.floor(F.col("id") / 100).alias("hidx"), F.lit(1.0).alias("y"),
    )
    out = ordered.lagged(hot.unionByName(cold), PanelSpec(chunk_rows=256), {"l": (F.col("y"), 24)})
    rows = out.filter("unique_id = 'hot' AND hidx >= 24").select((F.col("y") - F.col("l")).alias("d")).distinct().collect()
    assert [r.d for r in rows] == [24.0]


def test_numbering_needs_no_global_sort(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.concat(F.lit("v"), F.pmod("id", F.lit(37)).cast("string")).alias("v"))
    pos = [r.pos for r in ordered.global_index(df, ["k"]).orderBy("pos").collect()]
    assert pos == list(range(5000))
    codes = ordered.sorted_codes(df, "v", splits=5).orderBy("code").collect()
    assert [r.code for r in codes] == list(range(37))
    assert [r.v for r in codes] == sorted(r.v for r in codes)


def test_bracketed_quantiles_are_exact_on_a_hot_tied_group(spark):
    rng = np.random.default_rng(3)
    hot = np.concatenate([np.zeros(10_000), rng.lognormal(0, 3, 21_000)])
    pdf = pd.concat(
        [pd.DataFrame({"k": "hot", "v": hot}), pd.DataFrame({"k": "one", "v": [3.5]}), pd.DataFrame({"k": "few", "v": [1.0, 2.0, 9.0]})]
    ).sample(frac=1, random_state=0)
    df = spark.createDataFrame(pdf)
    wanted = {f"q{int(p * 100)}": ("v", p) for p in (0.1, 0.5, 0.9)}
    out = quantiles.grouped(df, ["k"], wanted, bounded=False).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        for name, (_, p) in wanted.items():
            assert out.loc[k, name] == pytest.approx(g.v.quantile(p), rel=1e-12), (k, name)
    assert quantiles.grouped(df.withColumn("g", F.lit(1)), ["g"], {"q": ("v", 0.5)}, bounded=False).first().q == pytest.approx(pdf.v.median())
    assert quantiles.pooled(df, ["v"])["v"] == pytest.approx(pdf.v.median())


def test_average_rank_matches_pandas(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(0, 1, 6000), 1)
    pdf = pd.DataFrame({"i": np.arange(6000), "k": np.arange(6000) % 3, "v": np.where(rng.random(6000) < 0.1, np.nan, v)})
    df = to_spark(spark, pdf)
    out = pull(quantiles.average_rank(df, ["k"], "v", "r"), "i")
    np.testing.assert_allclose(out.r.to_numpy(float), pdf.groupby("k").v.rank(pct=True).to_numpy(), rtol=1e-12)


def test_pooled_quantiles_narrow_to_the_value(spark):
    """Many passes are forced by reading very few values at once; ties, infinities and empty columns included."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=30_000), "b": np.where(rng.random(30_000) < 0.7, 0.0, rng.exponential(size=30_000)), "c": np.repeat([5.0, 1e300], 15_000), "d": np.nan})
    df = spark.createDataFrame(pdf).withColumn("d", F.lit(None).cast("double")).cache()
    kept = quantiles.FEW
    try:
        quantiles.FEW = 3
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            got = quantiles.pooled(df, ["a", "b", "c", "d"], p)
            assert got["d"] is None
            for c in "abc":
                assert got[c] == pytest.approx(float(pdf[c].quantile(p)), rel=1e-12)
    finally:
        quantiles.FEW = kept
    assert quantiles.pooled(df.limit(0), ["a"]) == {"a": None}


def test_memory_over_very_many_chunks(spark):
    """A series of 100,000 chunks: no row holds them, and the state of any chunk reaches as far as it matters."""
    n = 200_000
    df = spark.range(n).select(F.lit("a").alias("unique_id"), F.col("id").alias("hidx"), (F.col("id") * 7919 % 101).cast("double").alias("x"))
    out = ordered.ewma(df, PanelSpec(chunk_rows=2), {"h": (F.col("x"), 3.0), "slow": (F.col("x"), 5_000.0)})
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    want = pd.Series(np.arange(n) * 7919 % 101, dtype=float)
    got = out.orderBy("hidx").toPandas()
    np.testing.assert_allclose(got.h, want.ewm(halflife=3, adjust=False).mean(), rtol=1e-9)
    np.testing.assert_allclose(got.slow, want.ewm(halflife=5_000, adjust=False).mean(), rtol=1e-9)


def test_memory_of_several_series_and_of_the_system(spark):
    df = spark.range(900).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("unique_id"), F.floor(F.col("id") / 3).alias("hidx"), (F.col("id") * 31 % 17).cast("double").alias("x"))
    out = ordered.ewma(df, PanelSpec(chunk_rows=7), {"h": (F.col("x"), 0.01), "g": (F.col("x"), 2.0)}).toPandas()
    for _, part in out.sort_values("hidx").groupby("unique_id"):
        for h, c in ((0.01, "h"), (2.0, "g")):
            np.testing.assert_allclose(part[c], part.x.ewm(halflife=h, adjust=False).mean(), rtol=1e-9, atol=1e-12)
    alone = df.filter("unique_id = 's0'").drop("unique_id")
    out = ordered.ewma(alone, PanelSpec(chunk_rows=7), {"g": (F.col("x"), 2.0)}, keys=()).orderBy("hidx").toPandas()
    np.testing.assert_allclose(out.g, out.x.ewm(halflife=2, adjust=False).mean(), rtol=1e-9)


def test_grouped_quantiles_are_narrowed_until_few_values_are_left(spark, monkeypatch):
    for name, value in (("FEW", 20), ("SMALL_GROUP", 30), ("MARGIN", 0.05), ("MARKS", 16)):
        monkeypatch.setattr(quantiles, name, value)
    df = spark.range(9_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 2, F.col("id") % 5).otherwise(F.col("id") * 7919 % 9_001).cast("double").alias("v"))
    wanted = {f"q{i}": ("v", p) for i, p in enumerate((0.0, 0.03, 0.5, 0.77, 1.0))}
    pdf = df.toPandas()
    for few_keys in (False, True):
        for r in quantiles.grouped(df, ["g"], wanted, bounded=False, few_keys=few_keys).collect():
            for n, (_, p) in wanted.items():
                assert r[n] == pytest.approx(pdf.v[pdf.g == r.g].quantile(p)), (r.g, p)


def test_pooled_ranks_in_one_run(spark):
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_003).cast("double").alias("v"), F.when(F.col("id") < 3, F.col("id")).cast("double").alias("w"), F.lit(None).cast("double").alias("none"))
    got = quantiles.pooled_many(df, {"a": ("v", 0.2), "b": ("v", 0.8), "c": ("v", 0.5), "d": ("w", 0.5), "e": ("none", 0.5)})
    pdf = df.toPandas()
    assert [got[k] for k in "abc"] == [pytest.approx(pdf.v.quantile(p)) for p in (0.2, 0.8, 0.5)] and got["d"] == 1.0 and got["e"] is None
