"""Session helpers: settings this engine relies on, and a shared place to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash ``df`` over the session's shuffle partitions, a count that is kept as it is.

    For small rows that are about to grow (a calendar unrolled per key) or be read many times (rows a
    model is fitted on): their size before that says nothing about how many tasks they need.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, where driver and tasks share a disk, gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from there; survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new Parquet folder of the shared folder and read it from there, for work that reads few of its columns or often."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place, compression="zstd")
    out = spark.read.schema(df.schema).parquet(place)
    out.kept_at = place
    return out


def discard(kept: DataFrame) -> None:
    """Remove the files of a :func:`stored` table that nothing reads any more, and let Spark drop the shuffles that made it.

    Spark drops shuffle files when the driver finds their plans unused, which may be long after; so it is asked to look.
    """
    jvm = kept.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(kept.kept_at)
    path.getFileSystem(kept.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()
