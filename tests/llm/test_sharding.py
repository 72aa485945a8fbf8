from __future__ import annotations

import struct
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from panelloom.llm import sharding
from panelloom.llm.queries import QUERIES
from tests.llm.helpers import DOCS, docs, rows


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def place(doc_id, n):
    return plain_jump(42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42), n)


def check(table, got, shards=40):
    assert len(got) == len(table)
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), place(i, shards), place(i, shards + 1)) for i, t in table), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got), key=str) == want
    assert all(r["grown_shard"] in (r["shard"], shards) for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_jump_against_the_plain_loop():
    keys = np.random.default_rng(1).integers(0, 2**64, 500, np.uint64)
    for n in (1, 2, 40, 41, 1000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_odd_rows(spark):
    table = [(None, None), (None, None), (1, ""), (1, ""), (1, "é"), (-5, "x" * 100_000), (2**62, "漢")] + [(7, "same")] * 25_000 + [(i, "t") for i in range(100, 300)]
    check(table, rows(sharding.shard_documents(docs(spark, table).withColumns({"slot": F.lit(1), "_hash": F.lit(2), "shard": F.lit("z")}))))
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_slots_do_not_depend_on_buckets(spark):
    from panelloom.llm.common import number_within

    df = spark.range(3_000).selectExpr("id", "id % 3 AS g", "id % 4 AS w")
    a, b = (sorted(map(tuple, number_within(df, ["g"], ["id"], "n", "w", per_bucket=p).collect())) for p in (10**6, 100))
    assert a == b


def test_written_shards_hold_whole_rows(spark, tmp_path):
    table = docs(spark, [f"text {i}" for i in range(200)])
    sharding.write_shards(table, ["doc_id"], 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.shard) for r in back.collect()) == [(i, f"text {i}", place(i, 4)) for i in range(200)]


def test_query_over_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    check([(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()], rows(QUERIES["op10_jump_sharding"](spark, folder)))
