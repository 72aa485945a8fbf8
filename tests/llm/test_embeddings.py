from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from panelloom.llm import embeddings
from panelloom.llm.queries import QUERIES
from tests.llm.helpers import classes

VECTORS = "vec_id long, embedding array<float>, label int"


def expected(vectors):
    ok = [v is not None and l is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v, l in vectors]
    links = []
    for a in range(len(vectors)):
        for b in range(a):
            if ok[a] and ok[b] and vectors[a][2] == vectors[b][2] and len(vectors[a][1]) == len(vectors[b][1]):
                x, y = (np.array(vectors[i][1], np.float32).astype(float) for i in (a, b))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((a, b))
    root = classes(len(vectors), links)
    least = {r: min(vectors[i][0] for i in range(len(vectors)) if root[i] == r) for r in root}
    n = [sum(i in p for p in links) for i in range(len(vectors))]
    return sorted((v[0], n[i], least[root[i]], v[0] == least[root[i]]) for i, v in enumerate(vectors))


def got(df, **kw):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, **kw).collect())


def made(seed=1, n=150, size=16):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            _, v, l = out[rng.integers(len(out))]
            v = (np.array(v) + rng.standard_normal(size) * rng.choice([0.0, 0.03, 0.06])).tolist()
        else:
            v, l = rng.standard_normal(size).tolist(), int(rng.integers(2))
        out.append((i, [float(np.float32(x)) for x in v], l))
    return out


def test_links_counts_and_components(spark):
    v = made()
    df = spark.createDataFrame(v, VECTORS)
    assert got(df) == expected(v)
    assert got(df, cap=4) == expected(v)  # keys cut into blocks


def test_odd_vectors(spark):
    v = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, float("nan")], 0), (5, [1.0, float("inf")], 0), (6, [1.0, None], 0), (7, [1.0, 0.0], None),
        (8, [1.0, 0.0], 0), (9, [1.0, 0.0], 0), (10, [2.0, 0.0], 0), (11, [1.0, 0.0], 1), (12, [1.0, -0.0], 0), (13, [1.0, 0.0, 0.0], 0), (14, [-1.0, 0.0], 0),
    ]
    df = spark.createDataFrame(v, VECTORS).withColumns({"cls": F.lit(1), "run": F.lit(2), "copies": F.lit(3)})
    assert got(df) == expected(v)


def test_empty_null_and_repeated_ids(spark):
    assert got(spark.createDataFrame([], VECTORS)) == []
    df = spark.createDataFrame([(None, [1.0, 2.0], 0), (3, [1.0, 2.0], 0), (3, [1.0, 2.0], 0), (None, None, None)], VECTORS)
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()), key=str)
    assert found == [(3, 2, 3, True), (3, 2, 3, True), (None, 0, None, False), (None, 2, 3, False)]


def test_query_over_whole_table(spark):
    folder = "/root/testdata/sf0.1"
    v = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in QUERIES["op4_embedding_dedup"](spark, folder).collect()) == expected(v)
