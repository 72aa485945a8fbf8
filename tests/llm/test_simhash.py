from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelloom.llm import simhash
from panelloom.llm.queries import QUERIES
from tests.llm.helpers import DOCS, by, classes, docs


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected(pairs):
    fps = [plain(t) for _, t in pairs]
    near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    root = classes(len(fps), near)
    least = {r: min(pairs[i][0] for i in range(len(fps)) if root[i] == r) for r in root}
    return {p[0]: (f"{f:016x}", least[r]) for p, f, r in zip(pairs, fps, root)}


def test_edges_and_ties(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop")
    base = [word() for _ in range(400)]
    pairs = [(10, None), (11, ""), (12, " \t\n"), (13, "one"), (14, "One"), (15, "a b c"), (16, "é Ü ß x y"), (17, "É Ü ß x y")]
    pairs += [(20 + i, " ".join(base[:i] + [word()] + base[i + 1 :])) for i in range(30)]
    pairs += [(60 + i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(80)]
    pairs += [(200, " ".join(base * 30)), (201, "\n".join(base * 30))]
    got = by(simhash.simhash_components(docs(spark, pairs)))
    want = expected(pairs)
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == want
    assert got[10]["component_id"] == 10 and got[12]["fingerprint"] == "0" * 16


def test_links_of_close_numbers_blocks_included(spark):
    """Dense groups, with a cap so small that cells are cut into blocks."""
    rng = random.Random(5)
    nums = {0}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
            nums.add(x)
    nums = sorted(nums)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in nums], "fp long")
    want = classes(len(nums), [(a, b) for a in range(len(nums)) for b in range(a) if (nums[a] ^ nums[b]).bit_count() <= 4])
    for cap in (4096, 8):
        found = [(nums.index(int(np.int64(r.src).view(np.uint64))), nums.index(int(np.int64(r.dst).view(np.uint64)))) for r in simhash.links(df, 4, cap).collect()]
        assert all((nums[a] ^ nums[b]).bit_count() >= 1 for a, b in found)
        assert classes(len(nums), found) == want


def test_empty_null_ids_and_extra_columns(spark):
    assert simhash.simhash_components(spark.createDataFrame([], DOCS)).count() == 0
    odd = docs(spark, [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "zzz")]).withColumns({"fp": F.lit(1), "cell": F.lit(2), "key": F.lit(3), "component_id": F.lit(4)})
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_components(odd).collect()), key=str)
    assert got == [(7, 7), (7, 7), (None, 7), (None, None)]


def test_query_over_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = by(QUERIES["op8_simhash_dedup"](spark, folder))
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == expected(pairs)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5])
def test_shingles_of_short_texts(n):
    w = ["a", "b", "c", "d", "e"][:n]
    want = [xxhash.xxh64_intdigest(" ".join(g), 42) for g in ([w[i : i + 4] for i in range(n - 3)] if n > 4 else [w] if n else [])]
    assert simhash.shingle_hashes(" ".join(w).encode(), 4).tolist() == want
