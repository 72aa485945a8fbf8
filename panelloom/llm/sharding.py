"""Shards by jump consistent hashing (Lamping and Veach).

A key's shard is found by a short sequence of jumps of a linear congruential generator seeded by the
key: no ring, no table. When a shard is appended, a key either stays or jumps to the new shard.

Nulls: a null key is a key like any other; a null text has no bytes and the checksum of no bytes. Repeated rows
get slots of their own. An empty table gives an empty result. Clashing names: operators add only
the columns they are told to add, under free helper names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import number_within

#: Fixed value of the published algorithm.
MULTIPLIER = np.uint64(2862933555777941757)
ROW_BYTES = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    key = np.asarray(keys).astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while live.size:
        shard[live] = ahead[live]
        key[live] = key[live] * MULTIPLIER + np.uint64(1)
        ahead[live] = ((shard[live] + 1) * (2.0**31 / ((key[live] >> np.uint64(33)) + np.uint64(1)))).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard


def assign_shards(df: DataFrame, key: Sequence[str], shards: int, out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; only the key columns and ``shards`` decide."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def shard(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy().view(np.uint64), shards), dtype="int32")

    return df.withColumn(out, shard(F.xxhash64(*key)))


def slots(df: DataFrame, key: Sequence[str], shards: int) -> DataFrame:
    """Rows of ``df`` with ``shard``, ``grown_shard`` (one shard more) and ``slot``, gapless from 0 in each shard.

    Equal rows are counted before they are numbered and dealt out again in pieces, so neither a key
    nor a row that makes up a third of the table meets in one task.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    placed = assign_shards(assign_shards(counted, key, shards), key, shards + 1, "grown_shard")
    numbered = number_within(placed, ["shard"], df.columns, "_first", weight="_copies")
    piece = 10_000
    pieces = numbered.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(piece).cast("long"))))
    pieces = pieces.repartition("shard", "_first", "_from")
    last = F.least(F.col("_from") + piece, F.col("_copies")) - 1
    each = pieces.withColumn("_copy", F.explode(F.sequence(F.col("_from"), last)))
    return each.withColumn("slot", F.col("_first") + F.col("_copy")).drop("_copies", "_first", "_from", "_copy")


def write_shards(df: DataFrame, key: Sequence[str], shards: int, path: str) -> None:
    """Write whole rows as one folder per shard; a shard may be several files, none is one task's burden."""
    assign_shards(df, key, shards).write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The digest of the sharding: one row per document with size, checksum, shard and slot."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(data) + ROW_BYTES).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return slots(rows, ["doc_id"], shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int")
    )
