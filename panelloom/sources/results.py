"""Result files of model runs to one sorted table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "name string, model string, train_wape double, n_params long, train_seconds double, "
    "cross_validation struct<cv_wape_mean: double, cv_wape_std: double>, "
    "gapped_eval struct<gapped_metrics: struct<wape: double>>"
)
SORTS = ("auto", "cv_wape", "gapped_wape", "train_wape")


def summarize(spark: SparkSession, folder: str, sort: str = "auto") -> DataFrame:
    """One row per file that names a model, best first, runs without the sorted score last."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}, got {sort!r}")
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    table = raw.filter(F.col("model").isNotNull()).select(
        F.coalesce("name", F.lit("?")).alias("name"),
        "model",
        F.col("cross_validation.cv_wape_mean").alias("cv_wape"),
        F.col("cross_validation.cv_wape_std").alias("cv_std"),
        F.col("gapped_eval.gapped_metrics.wape").alias("gapped_wape"),
        "train_wape",
        F.col("n_params").alias("params"),
        F.col("train_seconds").alias("train_s"),
    )
    by = F.coalesce("cv_wape", "train_wape") if sort == "auto" else F.col(sort)
    return table.orderBy(by.asc_nulls_last(), "name")
