from __future__ import annotations

from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelloom.llm import mixing
from panelloom.llm.queries import QUERIES


def plain_schedule(blocks, weights, period):
    """Slot by slot: the released block with the earliest deadline; shares anew whenever a source ends."""
    rest, out = {s: n for s, n in blocks.items() if n}, []
    while rest:
        slots = mixing.shares({s: weights[s] for s in rest if weights[s] > 0} or {s: rest[s] for s in rest}, period)
        size, used, t = sum(slots.values()), Counter(), 0
        while True:
            ready = [(-(-(used[s] + 1) * size // slots[s]), s) for s in slots if used[s] * size // slots[s] <= t]
            deadline, s = min(ready)
            assert deadline > t  # never missed
            used[s] += 1
            t += 1
            out.append(s)
            for x in slots:
                assert abs(used[x] - Fraction(slots[x] * t, size)) < 1
            rest[s] -= 1
            if not rest[s]:
                del rest[s]
                break
    return out


def laid_out(plan):
    out = {}
    for s, first, end, places, a, size, clock in plan:
        for k in range(first, end):
            j = k - first
            out[clock + j // a * size + places[j % a]] = s
    assert sorted(out) == list(range(len(out)))
    return [out[t] for t in range(len(out))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.sampled_from([0.0, 0.3, 1.0, 2.5, 7.0])), min_size=1, max_size=6), st.sampled_from([7, 20, 100]))
def test_schedule_against_slot_by_slot(sources, period):
    blocks, weights = {i: n for i, (n, _) in enumerate(sources)}, {i: w for i, (_, w) in enumerate(sources)}
    assert laid_out(mixing.phases(blocks, weights, period)) == plain_schedule(blocks, weights, period)


def test_deviation_from_the_weights_over_many_periods():
    """One large and nineteen equal sources; and one far below a thousandth."""
    for blocks in ({0: 60_000, **{s: 6_300 for s in range(1, 20)}}, {0: 60_000, 1: 30_000, 2: 12}):
        weights = {s: n**0.5 for s, n in blocks.items()} if len(blocks) > 3 else {0: 1.0, 1: 0.5, 2: 0.0002}
        first = min(blocks.values()) if len(blocks) > 3 else 50_000
        order = laid_out(mixing.phases(blocks, weights, mixing.PERIOD))
        total, used = sum(map(Fraction, weights.values())), Counter()
        for t, s in enumerate(order[: 30_000 if len(blocks) == 3 else first * 15]):
            used[s] += 1
            assert abs(used[s] - Fraction(weights[s]) / total * (t + 1)) < 1
        assert Counter(order) == blocks


def mixed(df, **kw):
    return mixing.mix(df, "source", ["id"], **kw).orderBy("position").collect()


def test_nothing_lost_and_weights_hold(spark):
    df = spark.range(4_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('s', id % 5) END AS source", "1 AS _first", "2 AS slot2")
    weights = spark.createDataFrame([("hot", 1.0), (None, 3.0)] + [(f"s{i}", 1.0) for i in range(5)], "source string, weight double")
    out = mixed(df, weights=weights, block_rows=8)
    assert sorted(r.id for r in out) == list(range(4_000)) and len({r.position for r in out}) == 4_000
    share = Counter(r.source for r in out[:800])
    assert abs(share[None] - 800 * 3 / 9) <= 8 and abs(share["hot"] - 800 / 9) <= 8
    order = [r.id for r in out if r.source == "hot"]
    assert order == [r.id for r in spark.range(4_000).filter("id % 3 = 0").withColumn("h", F.xxhash64("id")).orderBy(F.col("h") < 0, "h").collect()]


def test_one_source_few_rows_empty_and_bad_weights(spark):
    one = spark.range(5).selectExpr("id", "'a' AS source")
    assert len({r.position for r in mixed(one)}) == 5
    assert mixed(one.limit(0)) == []
    assert len(mixed(one.union(one))) == 10
    for bad in ([("b", 1.0)], [("a", None)], [("a", -1.0)]):
        with pytest.raises(ValueError):
            mixed(one, weights=spark.createDataFrame(bad, "source string, weight double"))


def test_query_over_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    out = QUERIES["op3_source_mixing"](spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").groupBy("source").count().collect()
    names = sorted(r["source"] for r in docs)
    sizes = {r["source"]: r["count"] for r in docs}
    blocks = {i: -(-sizes[n] // 16) for i, n in enumerate(names)}
    want = plain_schedule(blocks, {i: sizes[n] ** 0.5 for i, n in enumerate(names)}, mixing.PERIOD)
    got = {r.slot: names.index(r.source) for r in out}
    assert [got[t] for t in range(len(want))] == want
    assert sorted(r.doc_id for r in out) == list(range(sum(sizes.values())))
    assert all(r.slot * 16 + r.source_row % 16 == r.position and r.block == r.source_row // 16 for r in out)
