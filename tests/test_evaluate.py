"""Scoring, bootstrap, admission, blending and provenance."""

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions import metrics as M
from panelloom.functions import ordered
from panelloom.operators import aggregates, blend, diagnose, evaluate, provenance, runners
from panelloom.operators.assembly import join_members
from panelloom.operators.members import from_residual_target, to_residual_target
from panelloom.spec import PanelSpec
from tests.fixtures import pull

SPEC = PanelSpec(score_len=12, late_from=8, series_len=100)
MEMBERS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cube(spark):
    rng = np.random.default_rng(7)
    keys = list(itertools.product([30, 42, 54], [f"u{i}" for i in range(6)], range(12)))
    pdf = pd.DataFrame(keys, columns=["cutoff", "unique_id", "blk"])
    y = rng.uniform(5, 50, len(pdf))
    pdf["ds"] = pd.Timestamp("2023-01-01") + pd.to_timedelta(pdf.cutoff + pdf.blk, unit="h")
    pdf["step"] = pdf.blk + 13
    pdf["y"], pdf["a"], pdf["b"], pdf["c"] = y, y + rng.normal(0, 3, len(y)), y + rng.normal(1, 4, len(y)), y + rng.normal(-2, 6, len(y))
    return pdf, spark.createDataFrame(pdf).repartition(4).cache()


def wape(y, p):
    return float(np.abs(y - p).sum() / np.abs(y).sum())


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 1.0), (4.0, 4.0)], "y double, p double")
    row = df.agg(*M.named(M.zero_aware(F.col("y"), F.col("p")))).first()
    assert row["wape"] == pytest.approx(0.4) and row["mae"] == pytest.approx(2 / 3) and row["mape"] is None
    assert row["mape_nonzero"] == pytest.approx(0.5) and row["smape"] == pytest.approx((2 / 3 + 2 + 0) / 3)
    assert row["smape_zero_share"] == pytest.approx(round(2 / 3 / row["smape"], 4))
    zero = spark.createDataFrame([(0.0, 1.0)], "y double, p double").agg(M.wape(F.col("y"), F.col("p"))).first()[0]
    assert zero is None


def test_pooled_is_not_the_mean_of_windows(cube):
    pdf, df = cube
    out = evaluate.pooled_wape(df, SPEC, ["a"], "late").toPandas()
    late = pdf[pdf.blk >= 8]
    assert out[out.cutoff.isna()].wape.item() == pytest.approx(wape(late.y, late.a))
    for c, g in late.groupby("cutoff"):
        assert out[out.cutoff == c].wape.item() == pytest.approx(wape(g.y, g.a))


@pytest.mark.parametrize(
    "damage",
    [
        lambda d: d.drop("a"), lambda d: d.limit(0), lambda d: d.withColumn("a", F.when(F.col("blk") > 0, F.col("a"))),
        lambda d: d.unionByName(d.limit(1)), lambda d: d.filter("NOT (unique_id = 'u0' AND blk = 3 AND cutoff = 30)"),
        lambda d: d.withColumn("a", F.when(F.col("blk") > 0, F.col("a")).otherwise(F.lit(float("nan")))),
    ],
)
def test_bad_prediction_frames_are_refused(cube, damage):
    _, df = cube
    assert evaluate.validate_prediction(df, SPEC, "a") is df
    with pytest.raises(ValueError):
        evaluate.validate_prediction(damage(df), SPEC, "a")


def test_bootstrap_of_a_member_against_itself_is_zero(cube):
    pdf, df = cube
    same = evaluate.paired_bootstrap(df, SPEC, "a", "a", n_boot=50).first()
    assert same["delta"] == 0 and same["se"] == 0 and same["delta_in_se"] is None and same["n_blocks"] == 18
    row = evaluate.paired_bootstrap(df, SPEC, "a", "c", n_boot=400).first()
    assert row["delta"] == pytest.approx(wape(pdf.y, pdf.c) - wape(pdf.y, pdf.a))
    assert row["ci_low"] < row["delta"] < row["ci_high"] and row["ci_low"] > 0
    rng, e = np.random.default_rng(0), pdf.assign(c=(pdf.y - pdf.c).abs(), a=(pdf.y - pdf.a).abs()).groupby(["cutoff", "unique_id"])[["a", "c", "y"]].sum()
    draws = [e.iloc[rng.integers(0, 18, 18)].sum() for _ in range(2000)]
    assert row["se"] == pytest.approx(np.std([(d.c - d.a) / d.y for d in draws], ddof=1), rel=0.15)


def test_draws_are_uniform(spark):
    df = spark.range(200_000).select(evaluate.draw(3, F.floor(F.col("id") / 100), F.pmod("id", F.lit(100)), 100).alias("j"))
    counts = np.array([r["count"] for r in df.groupBy("j").count().collect()])
    assert len(counts) == 100 and ((counts - 2000) ** 2 / 2000).sum() < 160


def test_admission_reports_without_dropping(cube):
    _, df = cube
    row = evaluate.evaluate_admission(df, SPEC, "a", "c", "full", incumbents=["b", "c"]).first()
    assert row["pooled_improves"] and row["majority_improves"] and row["orthogonal"] and row["windows_required"] == 2
    assert evaluate.evaluate_admission(df, SPEC, "c", "a", "full").first()["orthogonal"] is None
    twin = evaluate.evaluate_admission(df.withColumn("d", F.col("a") * 1.0), SPEC, "a", "b", "full", incumbents=["d"]).first()
    assert not twin["orthogonal"]
    assert [evaluate.min_windows_required(n) for n in (1, 2, 3, 4, 6)] == [1, 2, 2, 3, 4]


def test_forward_folds_keep_the_embargo(cube):
    _, df = cube
    out = evaluate.folds(df, SPEC.with_(score_len=12), [30, 42, 54], 12).filter("instrument = 'forward'").toPandas()
    for fold, g in out.groupby("fold"):
        fit = g[g.role == "fit"]
        assert (fit.cutoff + 24 + 12 <= fold + 12).all() if len(fit) else True
        assert set(g[g.role == "score"].cutoff) == {fold}


def test_seeds_must_be_the_declared_prefix(spark):
    assert tuple(int(s) for s in np.random.default_rng(42).integers(0, 10000, size=5)) == aggregates.FROZEN_SEEDS
    runs = aggregates.from_scores({892: 0.1, 7739: 0.2, 6545: 0.3}, spark).withColumn("m", F.lit("x"))
    row = aggregates.summarize_seeds(runs, ["m"]).first()
    assert row["mean"] == pytest.approx(0.2) and row["std"] == pytest.approx(0.1) and not row["complete"]
    for bad in ({892: 0.1, 4388: 0.2}, {42: 0.1}):
        with pytest.raises(ValueError):
            aggregates.summarize_seeds(aggregates.from_scores(bad, spark).withColumn("m", F.lit("x")), ["m"])
    with pytest.raises(ValueError):
        aggregates.frozen_seeds(6)


def test_simplex_beats_a_fine_grid(cube):
    pdf, df = cube
    y, p = pdf.y.to_numpy(), pdf[MEMBERS].to_numpy()
    w = blend.fit_simplex(df, SPEC, MEMBERS)
    assert sum(w.values()) == pytest.approx(1) and min(w.values()) >= 0
    best = min(
        np.abs(y - p @ np.array([i, j, 100 - i - j]) / 100).sum() for i in range(101) for j in range(101 - i)
    )
    assert np.abs(y - p @ np.array([w[m] for m in MEMBERS])).sum() <= best * 1.002
    two = blend.fit_simplex(df, SPEC, ["a", "b"])
    fine = min((np.abs(y - (g * p[:, 0] + (1 - g) * p[:, 1])).sum(), g) for g in np.linspace(0, 1, 4001))
    assert two["a"] == pytest.approx(fine[1], abs=1e-3)
    # The histogram path must land on the same value as reading all values.
    r, d = F.col("y") - F.col("b"), F.col("a") - F.col("b")
    assert blend._steps_curve(df, r, d, bins=4, exact_below=3) == pytest.approx(two["a"], abs=1e-9)


def test_blend_guards(cube):
    _, df = cube
    with pytest.raises(ValueError):
        blend.convex({"a": 0.5, "b": 0.6})
    rungs = (("full", {"x": 1.0}), ("two", {"a": 0.4, "b": 0.6}))
    assert blend.choose_rung(["a", "b"], rungs)[0] == "two"
    with pytest.raises(ValueError):
        blend.choose_rung(["q"], rungs)
    with pytest.raises(ValueError):
        blend.seed_bag(df, "net", "bag")


@pytest.mark.parametrize("gamma", [0.9, 1.0, 1.04])
def test_desmooth_keeps_the_anchor_and_scales_the_spread(cube, gamma):
    _, df = cube
    out = blend.desmooth(df.withColumn("p", F.col("a") + 100), ["unique_id"], "p", gamma, "q")
    s = out.groupBy("unique_id").agg(F.avg("p").alias("mp"), F.avg("q").alias("mq"), F.stddev("p").alias("sp"), F.stddev("q").alias("sq")).toPandas()
    np.testing.assert_allclose(s.mp, s.mq)
    np.testing.assert_allclose(s.sq / s.sp, gamma)
    low = blend.desmooth(df.withColumn("p", F.col("y") - 40), ["unique_id"], "p", 1.04)
    assert low.filter("p < 0").count() == 0


def test_members_must_hold_the_same_rows(cube):
    _, df = cube
    keys = ["cutoff", "unique_id", "ds", "y"]
    frames = {m: df.select(*keys, m) for m in MEMBERS}
    assert join_members(frames, keys).count() == df.count()
    with pytest.raises(ValueError):
        join_members({**frames, "b": frames["b"].filter("cutoff < 54")}, keys)
    with pytest.raises(ValueError):
        join_members({**frames, "b": frames["b"].unionByName(frames["b"].limit(1))}, keys)


def test_residual_target_round_trips_and_refuses_holes(cube):
    pdf, df = cube
    one = df.filter("cutoff = 30")
    rest = to_residual_target(one, SPEC, "b").select("unique_id", "ds", F.col("y").alias("p"))
    back = pull(from_residual_target(rest, one, SPEC, "b", "p"), "unique_id", "ds")
    np.testing.assert_allclose(back.p, pdf[pdf.cutoff == 30].sort_values(["unique_id", "ds"]).y)
    with pytest.raises(ValueError):
        from_residual_target(rest, one.filter("blk > 0"), SPEC, "b", "p")


def test_provenance_fails_closed(spark):
    rolled = provenance.table(spark, "ch", [(s, 12) for s in range(0, 60, 12)], 60)
    assert provenance.leak_table(rolled, [24, 30], 24).orderBy("cutoff").toPandas().leak_hours.tolist() == [12, 18]
    with pytest.raises(ValueError, match="past it"):
        provenance.check_honest(rolled, "ch", 24, 24)
    provenance.check_honest(rolled, "ch", 24, 12)
    with pytest.raises(ValueError):
        provenance.check_honest(None, "ch", 24, 12)
    with pytest.raises(ValueError):
        provenance.check_honest(rolled, "other", 24, 12)
    both = provenance.merge([rolled, provenance.table(spark, "d2", [(24, 24)], 60)])
    with pytest.raises(ValueError, match="name the one"):
        provenance.select(both)
    with pytest.raises(ValueError):
        provenance.merge([rolled, rolled])


def test_pairwise_zone_correlation_matches_pandas(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (7, 50)).cumsum(axis=1)
    zone = np.array([0, 0, 1, 1, 1, 2, 2])
    pdf = pd.DataFrame({"unique_id": np.repeat([f"u{i}" for i in range(7)], 50), "ds": np.tile(pd.date_range("2023-01-01", periods=50), 7), "y": x.ravel(), "zone": np.repeat(zone, 50)})
    out = diagnose.pairwise_zone_correlation(spark.createDataFrame(pdf), SPEC).toPandas().set_index("same_zone")
    c = np.corrcoef(x)
    same = [(c[i, j], zone[i] == zone[j]) for i in range(7) for j in range(i)]
    for flag in (True, False):
        assert out.loc[flag, "mean_corr"] == pytest.approx(np.mean([v for v, s in same if s == flag]))
        assert out.loc[flag, "pairs"] == sum(s == flag for _, s in same)


def test_runner_refusals(cube):
    _, df = cube
    member = runners.REGISTRY["naive"]
    for change in ({"seed": 1}, {"gap_cov": "maybe"}, {"regime": "middle"}, {"gap_fill": "how168"}):
        with pytest.raises(ValueError):
            runners.check(member, runners.Context(df, SPEC, 30, **change))
    with pytest.raises(ValueError):
        runners.check(runners.REGISTRY["tree"], runners.Context(df, SPEC, 30, regime="near"))
    runners.check(runners.REGISTRY["tree"], runners.Context(df, SPEC, 30, regime="near", gap_cov="real"))
    channel = runners.Member("x", "tree", lambda c: c.df, channels=("a",))
    with pytest.raises(ValueError, match="provenance"):
        runners.check(channel, runners.Context(df, SPEC, 30))
    with pytest.raises(KeyError):
        runners.run_member("nobody", runners.Context(df, SPEC, 30))
    with pytest.raises(ValueError):
        runners.register(member)
    assert math.isclose(sum(m.kind == "baseline" for m in runners.REGISTRY.values()), 3)


def test_simplex_leaves_a_kink_and_fits_all_sets_at_once(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(10, 4, (400, 4))
    y = p @ np.array([0.37, 0.11, 0.52, 0.0])
    y[::9] += 30.0
    names = ["a", "b", "c", "d"]
    rows = [(float(t), *map(float, r)) for t, r in zip(y, p)] + [(None, 1.0, 1.0, 1.0, 1.0), (1e6, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double, d double").repartition(3)
    sets = [("a", "b", "c", "d"), ("a", "b"), ("a", "b", "c"), ("d",), ("c", "a")]
    fits = blend.fit_simplexes(df, SPEC, sets)
    assert [tuple(f) for f in fits] == sets and all(sum(f.values()) == pytest.approx(1) and min(f.values()) >= 0 for f in fits)
    # The label is a blend with outliers, so the optimum is known.
    assert [fits[2][m] for m in "abc"] == pytest.approx([0.37, 0.11, 0.52], abs=0.01)

    def error(w):
        x = np.array([w.get(m, 0.0) for m in names])
        return np.abs(y - p @ x).sum()

    assert error(fits[0]) <= error({"a": 0.37, "b": 0.11, "c": 0.52}) * 1.01
    for k, members in enumerate(sets):
        assert error(fits[k]) <= min(error(w) for w in blend.simplex_grid(members, 20)) + 1e-9
        frank_wolfe = np.full(len(members), 1 / len(members))
        x = p[:, [names.index(m) for m in members]]
        for i in range(200):
            vertex = np.eye(len(members))[np.argmin(-np.sign(y - x @ frank_wolfe) @ x)]
            frank_wolfe = min((frank_wolfe + g * (vertex - frank_wolfe) for g in np.linspace(0, 1, 201)), key=lambda w: np.abs(y - x @ w).sum())
        assert error(fits[k]) <= np.abs(y - x @ frank_wolfe).sum() + 1e-6


def test_simplex_jobs_do_not_grow_with_the_sets(spark, cube):
    _, df = cube
    tracker = spark.sparkContext.statusTracker()

    def jobs(group, sets):
        spark.sparkContext.setJobGroup(group, group)
        blend.fit_simplexes(df, SPEC, sets, steps=1)
        spark.sparkContext.setJobGroup("", "")
        return len(tracker.getJobIdsForGroup(group))

    assert jobs("many", [tuple(MEMBERS), tuple(reversed(MEMBERS)), tuple(MEMBERS)]) == jobs("one", [tuple(MEMBERS)])


def test_bootstrap_is_the_same_in_one_slab_and_many(spark):
    n = 37
    values = [(c, f"u{u:02d}", 1.0 + u, 2.0 + (u * 7 + c) % 5, None if u == 3 else 10.0 + u) for c in (0, 50) for u in range(n)]
    blocks = spark.createDataFrame(values, "cutoff long, unique_id string, a double, b double, ya double")
    whole, cut = (
        {r.rep: r.delta for r in evaluate._replicates(blocks, SPEC, "a", "b", 25, 4, slab).collect()} for slab in (evaluate.SLAB, 9)
    )
    at = {(r.cutoff, r.unique_id): r.pos for r in ordered.global_index(blocks, ["cutoff", "unique_id"]).collect()}
    by_pos = {at[v[0], v[1]]: v[2:] for v in values}
    for rep in range(25):
        drawn = [by_pos[int(hashlib.md5(f"4:{rep}:{i}".encode()).hexdigest()[:8], 16) % len(values)] for i in range(len(values))]
        ya = sum(v[2] or 0.0 for v in drawn)
        want = sum(v[1] for v in drawn) / ya - sum(v[0] for v in drawn) / ya
        assert whole[rep] == pytest.approx(want) and cut[rep] == pytest.approx(want)
    assert evaluate._replicates(blocks.limit(0), SPEC, "a", "b", 25, 4).count() == 0
