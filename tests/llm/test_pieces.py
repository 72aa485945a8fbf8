from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.llm import pieces
from panelloom.llm.common import mixed
from panelloom.llm.queries import QUERIES
from tests.llm.helpers import DOCS, docs, rows


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.MODEL)


def logs(vocabulary):
    return {vocabulary.surface[i]: vocabulary.log[k] for k, i in enumerate(vocabulary.piece.tolist()) if i >= 0}


def all_segmentations(vocabulary, text):
    """Piece surfaces and log weight of every segmentation, found by plain recursion."""
    weight, mark = logs(vocabulary), " "
    full = mark + text

    def parts(i):
        if i == len(full):
            yield (), 0.0
            return
        single = full[i].encode() in weight
        for j in range(i + 1, min(len(full), i + vocabulary.longest) + 1):
            p = full[i:j]
            if mark in p[1:]:
                break
            if p.encode() in weight:
                for rest, w in parts(j):
                    yield (p, *rest), w + weight[p.encode()]
            elif j == i + 1 and not single:
                for rest, w in parts(j):
                    yield (p, *rest), w + vocabulary.byte_log * len(p.encode())

    found = dict(parts(0))
    total = math.log(sum(map(math.exp, found.values())))
    return {s: w - total for s, w in found.items()}


def drawn(vocabulary, texts, k, seed=0):
    batch = pieces.Batch(vocabulary, texts, mixed(np.arange(len(texts), dtype=np.uint64) + np.uint64(seed * 10**6)))
    paths, threshold = batch.samples(k)
    out = [[] for _ in texts]
    for have, path, at in paths:
        ids, ends = batch.spelled(path, at)
        log = [float(batch.graph.share[path[a:b]].sum()) for a, b in zip(at[:-1], at[1:])]
        for r, text, a, b, l in zip(have.tolist(), pieces.decoded(vocabulary, ids, ends), ends[:-1], ends[1:], log):
            assert text.decode() == texts[r]
            out[r].append((tuple(ids[a:b].tolist()), l))
    return out, threshold


def test_frequencies_without_replacement(vocabulary):
    n, text = 20_000, "the hat"
    exact = sorted((math.exp(w) for w in all_segmentations(vocabulary, text).values()), reverse=True)
    got, _ = drawn(vocabulary, [text] * n, 2)
    assert all(len({s for s, _ in g}) == 2 for g in got)
    by_prob = lambda i: Counter(round(math.exp(g[i][1]), 6) for g in got)
    first, second = by_prob(0), by_prob(1)
    for j, p in enumerate(exact[:3]):
        assert abs(first[round(p, 6)] / n - p) < 0.012
        q = sum(x * p / (1 - x) for i, x in enumerate(exact) if i != j)
        assert abs(second[round(p, 6)] / n - q) < 0.012


@pytest.mark.parametrize("text", ["a", "zz", "q", "xyz a", "a  b", "\n", "漢▁é", "ab\tab"])
def test_all_segmentations_come_out_in_the_end(vocabulary, text):
    want = all_segmentations(vocabulary, text)
    got, threshold = drawn(vocabulary, [text], len(want) + 3)
    assert len(got[0]) == len(want) == len({s for s, _ in got[0]}) and threshold[0] == -np.inf
    assert np.allclose(sorted(l for _, l in got[0]), sorted(want.values()))


def test_inclusion_scores_are_unbiased(vocabulary):
    """Weighting each segmentation by probability over inclusion estimates 1 without bias."""
    n = 4_000
    got, threshold = drawn(vocabulary, ["these hats"] * n, 3, seed=3)
    weigh = lambda l, t: math.exp(l) / -math.expm1(-math.exp(l - t))
    total = [sum(weigh(l, t) for _, l in g) for g, t in zip(got, threshold)]
    assert abs(np.mean(total) - 1) < 4 * np.std(total) / math.sqrt(n) + 1e-9


def test_long_and_odd_texts(vocabulary):
    rng = random.Random(2)
    texts = ["x" * 5_000, " ".join(rng.choice(["in", "there", "Über", "漢字", "▁", "\x00", "🙂"]) for _ in range(3_000)), "", " ", "  a ", "a\n\nb\r\n"]
    got, _ = drawn(vocabulary, texts, 3)
    assert [len(g) for g in got][:2] == [3, 3] and got[2] == [((), 0.0)]
    assert all(len({s for s, _ in g}) == len(g) for g in got)
    # the same row gives the same samples whatever stands beside it
    assert drawn(vocabulary, texts[:1], 3)[0][0] == got[0]


def test_encode_and_decode_tables(spark):
    table = docs(spark, [None, "", "the hat", (7, "the hat"), (7, "the hat"), (None, "é ▁")]).withColumns({"key": F.lit(1), "draw": F.lit(2), "sample": F.lit(3)})
    got = pieces.encode(table, samples=3)
    back = rows(pieces.decode(got.filter("pieces IS NOT NULL"), out="again"))
    assert all(r["exact"] and r["log_prob"] <= 1e-12 and r["log_inclusion"] <= 1e-9 for r in back)
    texts = {(r["doc_id"], r["sample"]): r["again"] for r in back}
    assert texts[2, 1] == texts[2, 3] == "the hat" and texts[0, 1] == "" and (0, 2) not in texts and texts[None, 1] == "é ▁"
    twins = [tuple(r["pieces"]) for r in back if r["doc_id"] == 7 and r["sample"] == 1]
    assert len(twins) == 2 and len(set(twins)) == 1
    assert pieces.encode(spark.createDataFrame([], DOCS)).count() == 0


def test_query_over_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    got = rows(QUERIES["op5_sentencepiece"](spark, folder))
    ids = [r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(r["doc_id"] for r in got if r["sample"] == 1) == sorted(ids)
    assert all(r["exact"] and r["n_pieces"] == len(r["pieces"]) for r in got)
