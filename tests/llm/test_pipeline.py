from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from panelloom.llm import mixing
from panelloom.llm.common import kept_table, table
from panelloom.llm.queries import quality_sql
from tests.check_oracle import connect
from tests.llm.helpers import DOCS, rows
from tests.llm.test_mixing import plain_schedule
from tests.llm.test_passages import repeats
from tests.llm.test_simhash import expected

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage is given and returns, written and read again."""
    docs, out = table(spark, FOLDER, "documents"), [None]
    out[0] = rows(docs)
    for name, stage in pipeline.STAGES:
        docs = kept_table(stage(spark, docs, FOLDER), name)
        out.append(rows(docs))
    return out


def test_stages_by_name():
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "simhash_dedup", "substring_dedup", "source_mixing", "sentencepiece"]


def test_quality_rules_against_sql(kept):
    want = connect(FOLDER).execute(f"WITH {quality_sql('documents')} SELECT doc_id FROM judged WHERE kept").fetchall()
    assert sorted(r["doc_id"] for r in kept[1]) == sorted(x for (x,) in want)
    before = {r["doc_id"]: r for r in kept[0]}
    assert all(before[r["doc_id"]] == r for r in kept[1])


def test_one_document_of_each_group_stays(kept):
    groups = expected([(r["doc_id"], r["text"]) for r in kept[1]])
    assert sorted(r["doc_id"] for r in kept[2]) == sorted(i for i, (_, c) in groups.items() if i == c)


def test_repeated_passages_are_cut_and_the_rest_stays(kept):
    before, after = {r["doc_id"]: r for r in kept[2]}, {r["doc_id"]: r for r in kept[3]}
    assert before.keys() == after.keys()
    doomed = repeats([(i, r["text"]) for i, r in before.items()])
    left = repeats([(i, r["text"]) for i, r in after.items()])
    assert sum(map(len, left.values())) <= 0.01 * sum(map(len, doomed.values()))
    changed = {i for i in before if before[i]["text"] != after[i]["text"]}
    assert set(doomed) <= changed and len(changed) <= 1.3 * len(doomed)
    for i, r in after.items():
        assert r["n_chars"] == len(r["text"])
        words = iter(before[i]["text"].split())
        assert all(w in words for w in r["text"].split())  # in order, none new


def test_mixture_holds_every_row_in_the_order_of_the_schedule(kept):
    key = lambda r: r["doc_id"]
    assert sorted(kept[4], key=key) == sorted(kept[3], key=key)
    names = sorted({r["source"] for r in kept[4]})
    sizes = {n: sum(r["source"] == n for r in kept[4]) for n in names}
    want = plain_schedule({i: -(-sizes[n] // 16) for i, n in enumerate(names)}, {i: sizes[n] ** 0.5 for i, n in enumerate(names)}, mixing.PERIOD)
    blocks, left = [], dict(sizes)
    for s in want:
        n = names[s]
        blocks += [n] * min(16, left[n])
        left[n] -= min(16, left[n])
    # the order of the last stage's result, read back, is the schedule row by row
    source = {r["doc_id"]: r["source"] for r in kept[4]}
    first = sorted((r for r in kept[5] if r["sample"] == 1), key=lambda r: r["position"])
    assert [source[r["doc_id"]] for r in first] == blocks
    assert all(r["position"] == other["position"] for r, other in zip(sorted(first, key=key), sorted((r for r in kept[5] if r["sample"] == 2), key=key)))


def test_written_order_is_the_mixture(spark):
    docs = table(spark, FOLDER, "documents")
    out = pipeline.source_mixing(spark, docs, FOLDER).collect()
    place = {r.doc_id: r.position for r in mixing.mix(docs.select("doc_id", "source"), "source", ["doc_id"]).collect()}
    assert [place[r.doc_id] for r in out] == sorted(place.values())


def test_segmentations_are_exact(kept):
    assert all(r["exact"] for r in kept[5])
    assert {r["doc_id"] for r in kept[5]} == {r["doc_id"] for r in kept[4]}


def test_run_gives_what_the_stages_give(spark, kept):
    got = rows(pipeline.run(spark, FOLDER))
    key = lambda r: (r["doc_id"], r["sample"])
    assert [(*key(r), r["pieces"]) for r in sorted(got, key=key)] == [(*key(r), r["pieces"]) for r in sorted(kept[5], key=key)]


def test_odd_rows_pass_every_stage(spark):
    good = " ".join(f"word{i}" for i in range(80))
    odd = spark.createDataFrame([(None, good, None, None, None), (1, good, "en", "a", 5), (1, good, "en", "a", 5), (2, None, "en", None, 0), (3, "", None, "b", 0)], DOCS)
    odd = odd.withColumns({c: F.lit(i) for i, c in enumerate(("row", "fp", "position", "_spans", "kept", "block", "sample", "_w"))})
    for docs in (odd, odd.limit(0)):
        for name, stage in pipeline.STAGES[:-1]:
            docs = kept_table(stage(spark, docs, FOLDER), name)
            assert docs.columns == odd.columns
        last = pipeline.STAGES[-1][1](spark, docs, FOLDER)
        assert {r["doc_id"] for r in rows(last)} in ({None, 1}, set())
