"""Member-cube store: a forecast is reused only when everything that produced it is the same."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

KEY_SCHEMA = "member string, digest string, key_json string"


def frame_identity(df: DataFrame) -> str:
    """Row count and order-free content sum of a frame."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")
    ).first()
    return f"{row['n']}:{row['h']}"


def cache_key(
    member: str, *, train_identity: str, cutoffs: Sequence[int], seed: int | None, config: Mapping | None,
    code: str, gap_cov: str = "impute", gap_fill: str = "median", nan_fill: str = "median", channels: Sequence[str] = (),
) -> dict | None:
    """Everything that decides a cube's content, the three imputation settings included.

    A member that does not declare its configuration cannot be told stale from fresh: no key.
    """
    if config is None:
        return None
    return {
        "member": member, "train_identity": train_identity, "cutoffs": [int(c) for c in cutoffs],
        "seed": seed, "config": dict(config), "code": code, "channels": list(channels),
        "gap_cov": gap_cov, "gap_fill": gap_fill, "nan_fill": nan_fill,
    }


def digest(key: Mapping) -> str:
    return hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:16]


def _place(root: str, member: str, key: Mapping) -> str:
    return f"{root}/member={member}/key={digest(key)}"


def store(cube: DataFrame, root: str, member: str, key: Mapping | None) -> str | None:
    """Write the cube, then its key: a cube without a key is an unfinished write and is never read."""
    if key is None:
        return None
    place = _place(root, member, key)
    cube.write.mode("overwrite").parquet(f"{place}/cube")
    row = [(member, digest(key), json.dumps(key, sort_keys=True, default=str))]
    cube.sparkSession.createDataFrame(row, KEY_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{place}/key")
    return place


def load(spark: SparkSession, root: str, member: str, key: Mapping | None) -> DataFrame | None:
    """The stored cube, or nothing on any doubt: absent, other key, column missing or holes in it."""
    if key is None:
        return None
    place = _place(root, member, key)
    try:
        found = spark.read.schema(KEY_SCHEMA).json(f"{place}/key").collect()
        cube = spark.read.parquet(f"{place}/cube")
    except AnalysisException:
        return None
    if len(found) != 1 or json.loads(found[0]["key_json"] or "null") != json.loads(json.dumps(key, default=str)):
        return None
    if member not in cube.columns or cube.filter(F.col(member).isNull() | F.isnan(member)).take(1):
        return None
    return cube
