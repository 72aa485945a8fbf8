from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.functions import linkage, spectral
from panelloom.operators import blocks
from panelloom.spec import PanelSpec

SPEC = PanelSpec(signals=("x1",), season=6, score_len=4, series_len=None, chunk_rows=16)


def panel(spark, values, parts=4):
    rows = [(f"u{i:03d}", t, None if np.isnan(v) else float(v)) for i, row in enumerate(values) for t, v in enumerate(row)]
    return spark.createDataFrame(rows, "unique_id string, hidx long, y double").repartition(parts)


def plain_linkage(r, k):
    """Average linkage step by step: the most similar two groups merge until k are left."""
    groups = [[i] for i in range(len(r))]
    while len(groups) > k:
        best = max(((np.mean([r[i][j] for i in a for j in b]), -min(a), -min(b)), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y)
        _, x, y = best
        groups[x] = groups[x] + groups.pop(y)
    return sorted(sorted(g) for g in groups)


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(4, 50))
    out = np.array([base[i % 4] * rng.uniform(0.3, 1.5) + rng.normal(size=50) * rng.uniform(0.3, 1.5) + 5 for i in range(23)])
    out[7] = 3.0  # no variation
    return out


def test_pair_correlations_over_tiles_and_spans(spark, values):
    pairs, codes = linkage.pair_correlations(panel(spark, values), "unique_id", "hidx", "y", tile=5, span=8)
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.nan_to_num(np.corrcoef(values))
    got = {(r.a, r.b): r.r for r in pairs.collect()}
    assert len(got) == 23 * 22 // 2
    assert all(got[a, b] == pytest.approx(want[a, b], abs=1e-9) for a, b in got)
    assert [r.code for r in codes.orderBy("unique_id").collect()] == list(range(23))


@pytest.mark.parametrize("k", [1, 4, 8, 30])
def test_groups_equal_average_linkage(spark, values, k):
    with np.errstate(invalid="ignore", divide="ignore"):
        want = plain_linkage(np.nan_to_num(np.corrcoef(values)), k)
    got = linkage.linked_groups(panel(spark, values), "unique_id", "hidx", "y", k).orderBy("unique_id").collect()
    groups = {}
    for i, r in enumerate(got):
        groups.setdefault(r.cluster, []).append(i)
    assert sorted(groups.values()) == want
    assert [min(groups[c]) for c in sorted(groups)] == sorted(min(g) for g in want)


def test_linkage_keeps_no_pairs(spark, monkeypatch):
    """What is kept grows with the series, not with their pairs, and tiles are as wide as their positions; slabs of any size give the same groups."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(9, 40))
    many = np.array([base[i % 9] + rng.normal(size=40) * 0.6 for i in range(90)])
    seen, checkpointed = [], linkage.checkpointed
    monkeypatch.setattr(linkage, "checkpointed", lambda df: (seen.append(out := checkpointed(df)), out)[1])
    want = plain_linkage(np.corrcoef(many), 6)
    for tile, span, slab in ((256, 2_048, 32 << 20), (16, 7, 16 * 40 * 8 * 2)):
        for name, x in (("TILE", tile), ("SPAN", span), ("SLAB", slab)):
            monkeypatch.setattr(linkage, name, x, raising=False)
        groups = {}
        for i, r in enumerate(linkage.linked_groups(panel(spark, many), "unique_id", "hidx", "y", 6).orderBy("unique_id").collect()):
            groups.setdefault(r.cluster, []).append(i)
        assert sorted(groups.values()) == want
    assert max(df.count() for df in seen) <= 90
    assert max(r[0] for df in seen if "packed" in df.columns for r in df.selectExpr("max(length(packed))").collect()) <= 256 * 40 * 8


def test_leading_vectors_equal_the_decomposition(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 120)) + 0.8 * rng.normal(size=(40, 120))
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    got = spectral.leading_vectors(panel(spark, x), "unique_id", "hidx", "y", 3, extra=2).orderBy("unique_id").collect()
    mine = np.array([r.u for r in got])
    for j in range(3):
        assert abs(mine[:, j] @ u[:, j]) == pytest.approx(1.0, abs=1e-10)
    assert mine.T @ mine == pytest.approx(np.eye(3), abs=1e-9)


def test_a_matrix_of_low_rank_has_fewer_vectors(spark):
    x = np.outer(np.arange(1.0, 8.0), np.arange(1.0, 12.0))
    got = spectral.leading_vectors(panel(spark, x), "unique_id", "hidx", "y", 3).orderBy("unique_id").collect()
    assert np.abs([r.u[0] for r in got]) == pytest.approx(np.arange(1.0, 8.0) / np.sqrt(140), abs=1e-9) and {len(r.u) for r in got} == {1}
    assert spectral.leading_vectors(panel(spark, np.empty((0, 0))), "unique_id", "hidx", "y", 3).collect() == []


def test_components_do_not_need_the_series_length(spark, values):
    df = panel(spark, values).withColumn("x1", F.col("y"))
    out, names = blocks.principal_components(df, SPEC, ["x1"], 40, 2)
    rows = out.groupBy("hidx").agg(*(F.max(n).alias(n) for n in names)).orderBy("hidx").collect()
    centred = values - values[:, :40].mean(axis=1, keepdims=True)
    u, _, _ = np.linalg.svd(centred[:, :40], full_matrices=False)
    for j, n in enumerate(names):
        want = u[:, j] @ centred
        mine = np.array([r[n] for r in rows])
        assert mine == pytest.approx(want if mine @ want > 0 else -want, abs=1e-6)
