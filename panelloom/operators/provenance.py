"""How a stored forecast column was produced, and whether a window may use it.

A provenance table has one row per block: ``(column, start, length, n_hours)``. A block covers the
positions ``[start, start+length)`` and conditioned on everything before ``start``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.spec import PanelSpec

SCHEMA = "column string, start long, length long, n_hours long, generator string, zero_shot boolean, reconstructed boolean, note string"
Block = tuple[int, int]


def table(
    spark: SparkSession, column: str, blocks: Sequence[Block], n_hours: int, generator: str = "", *,
    zero_shot: bool = False, reconstructed: bool = False, note: str = "",
) -> DataFrame:
    rows = [
        (column, int(s), int(n), int(n_hours), generator, zero_shot, reconstructed, note) for s, n in sorted(blocks)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def merge(parts: Sequence[DataFrame]) -> DataFrame:
    """Several channels' blocks side by side; a column may come from one part only."""
    out, seen = None, set()
    for p in parts:
        cols = {r["column"] for r in p.select("column").distinct().collect()}
        if cols & seen:
            raise ValueError(f"columns described twice: {sorted(cols & seen)}")
        seen |= cols
        out = p if out is None else out.unionByName(p)
    return out


def write(prov: DataFrame, path: str) -> None:
    prov.coalesce(1).write.mode("overwrite").json(path)


def read(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """The stored table; without a column name a multi-column table is refused."""
    return select(spark.read.schema(SCHEMA).json(path), column)


def select(prov: DataFrame, column: str | None = None) -> DataFrame:
    cols = sorted(r["column"] for r in prov.select("column").distinct().collect())
    if column is None:
        if len(cols) != 1:
            raise ValueError(f"provenance describes {len(cols)} columns {cols}; name the one you mean")
        return prov
    if column not in cols:
        raise ValueError(f"no provenance for column {column!r}; have {cols}")
    return prov.filter(F.col("column") == column)


def context_ends(prov: DataFrame, hours: DataFrame, hour: str = "hour") -> DataFrame:
    """Last position each hour's value could condition on, NULL where no block covers it.

    Blocks are unrolled to the hours they cover, so containment is an equi-join on (column, hour).
    """
    covered = prov.select(
        "column", "start", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias(hour)
    )
    ends = covered.groupBy("column", hour).agg((F.max("start") - 1).alias("context_end"))
    return hours.join(ends, ["column", hour], "left")


def leak_hours(cut: Column | int, horizon: int) -> Column:
    """Aggregate: how far past the cutoff the last offending block looked; 0 is honest."""
    c = cut if isinstance(cut, Column) else F.lit(cut)
    offends = (F.col("start") > c) & (F.col("start") < c + horizon)
    return F.coalesce(F.max(F.when(offends, F.col("start") - c)), F.lit(0)).cast("long")


def leak_table(prov: DataFrame, cutoffs: Sequence[int], horizon: int) -> DataFrame:
    """Leak per column and cutoff."""
    cuts = F.array(*(F.lit(int(c)).cast("long") for c in cutoffs))
    return prov.withColumn("cutoff", F.explode(cuts)).groupBy("column", "cutoff").agg(
        leak_hours(F.col("cutoff"), horizon).alias("leak_hours")
    )


def check_honest(prov: DataFrame | None, column: str, cut: int, horizon: int) -> DataFrame:
    """The column's rows when honest for this cutoff; absent, mismatched or leaking provenance raises."""
    if prov is None:
        raise ValueError(f"column {column!r} has no provenance, so its honesty cannot be verified")
    mine = select(prov, column)
    leak = mine.agg(leak_hours(cut, horizon).alias("n")).first()["n"]
    if leak:
        raise ValueError(f"column {column!r} is not honest at cutoff {cut}: its context runs {leak} hours past it")
    return mine


def audit(frame: DataFrame, prov: DataFrame, spec: PanelSpec, columns: Sequence[str], cutoffs: Sequence[int], horizon: int, routed: Sequence[str] | None = None) -> DataFrame:
    """Honesty, coverage and routing per (column, cutoff), with a verdict.

    The frame is read once: coverage counts for all cutoffs come from one aggregation.
    """
    i = F.col(spec.index)
    aggs = [F.min(F.when(F.col(c).isNotNull(), i)).alias(f"first_{c}") for c in columns]
    for c in columns:
        seen = F.col(c).isNotNull().cast("double")
        for k in cutoffs:
            aggs.append(F.avg(F.when(i < k, seen)).alias(f"t_{c}_{k}"))
            aggs.append(F.avg(F.when((i >= k) & (i < k + horizon), seen)).alias(f"h_{c}_{k}"))
    row = frame.agg(*aggs)
    parts = [
        F.struct(
            F.lit(c).alias("column"), F.lit(int(k)).cast("long").alias("cutoff"), F.col(f"first_{c}").alias("first_seen"),
            F.round(F.col(f"t_{c}_{k}"), 4).alias("train_coverage"), F.round(F.col(f"h_{c}_{k}"), 4).alias("horizon_coverage"),
            F.lit(routed is None or c in routed).alias("routed"),
        )
        for c in columns
        for k in cutoffs
    ]
    cover = row.select(F.explode(F.array(*parts)).alias("_p")).select("_p.*")
    starts = prov.groupBy("column").agg(F.min("start").alias("first_block"), F.count(F.lit(1)).alias("blocks"))
    out = cover.join(leak_table(prov, cutoffs, horizon), ["column", "cutoff"], "left").join(starts, "column", "left")
    verdict = (
        F.when(~F.col("routed"), "not routed")
        .when(F.col("leak_hours").isNull(), "no provenance")
        .when(F.col("leak_hours") > 0, "not honest")
        .when(F.coalesce(F.col("horizon_coverage"), F.lit(0.0)) < 1, "horizon incomplete")
        .when(F.col("first_seen").isNull(), "entirely missing")
        .when(F.col("first_seen") >= F.col("cutoff"), "horizon only")
        .when(F.col("first_seen") != F.col("first_block"), "frame and provenance disagree")
        .otherwise("ok")
    )
    return out.withColumn("verdict", verdict).withColumn("ok", F.col("verdict") == "ok")
