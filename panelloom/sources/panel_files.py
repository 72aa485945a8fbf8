"""Panel files: labelled CSV, covariate and index files, prediction output, Parquet scans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from panelloom.functions import ordered
from panelloom.functions.exprs import null_if_nan
from panelloom.operators import impute
from panelloom.spec import PanelSpec

RAW_ID, RAW_TIME, RAW_TARGET = "series_id", "timestamp", "target"
# Ids matched in an IN list are pushed into the Parquet scan; more of them are joined.
PUSHED_IDS = 10_000


def schema(doubles: Sequence[str], *, target: bool = True) -> T.StructType:
    fields = [T.StructField(RAW_ID, T.StringType()), T.StructField(RAW_TIME, T.TimestampType())]
    cols = [*([RAW_TARGET] if target else []), *doubles]
    return T.StructType([*fields, *(T.StructField(c, T.DoubleType()) for c in cols)])


def read_raw(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """CSV with header; NaN and empty cells are NULL. Only selected columns are parsed."""
    df = spark.read.schema(columns).csv(path, header=True, nanValue="NaN")
    doubles = [f.name for f in columns.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: null_if_nan(F.col(c)) for c in doubles})


def to_long(df: DataFrame, spec: PanelSpec) -> DataFrame:
    names = {RAW_ID: spec.id, RAW_TIME: spec.time, RAW_TARGET: spec.target}
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def load_long(spark: SparkSession, path: str, columns: T.StructType, spec: PanelSpec, stats: impute.FillStats | None = None, strategy: str = "median") -> tuple[DataFrame, impute.FillStats]:
    """Labelled CSV to an imputed long panel; statistics are fitted only when none are passed."""
    long = to_long(read_raw(spark, path, columns), spec)
    stats = stats or impute.fit_fill_stats(long, spec)
    return impute.apply_fill(long, spec, stats, strategy=strategy), stats


def load_window_long(long: DataFrame, spec: PanelSpec, cut: int, nan_fill: str = "median") -> DataFrame:
    """Imputed panel whose statistics come from rows before the cut only."""
    rows = long if spec.index in long.columns else ordered.row_index(long, spec)
    stats = impute.fit_fill_stats(rows.filter(F.col(spec.index) < cut), spec)
    return impute.apply_fill(rows, spec, stats, strategy=nan_fill)


def first_match(folder: str, exact: Sequence[str], pattern: str, read: Callable[[str], DataFrame]) -> DataFrame | None:
    """The first exact name that exists, else the first file (or folder) matching the pattern."""
    for name in exact:
        try:
            return read(f"{folder}/{name}")
        except AnalysisException:
            continue
    # The folder is listed, no file is read to learn its name.
    spark = SparkSession.active()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(f.getPath().toString() for f in found or [])
    return read(names[0]) if names else None


# The file names looked for before any pattern.
INDEX_NAMES = ("forecast_index_test.csv", "forecast_index_validation.csv")
COVARIATE_NAMES = ("test_input.csv", "validation_input.csv")


def load_forecast_index(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that need predictions: id and timestamp, with their position in the file."""
    cols = schema([], target=False)
    df = first_match(folder, INDEX_NAMES, "forecast_index*.csv", lambda p: spark.read.schema(cols).csv(p, header=True))
    if df is None:
        raise FileNotFoundError(f"no forecast_index*.csv in {folder}")
    return with_order(df)


def load_covariates(spark: SparkSession, folder: str, doubles: Sequence[str]) -> DataFrame | None:
    cols = schema(doubles, target=False)
    return first_match(folder, COVARIATE_NAMES, "*_input.csv", lambda p: read_raw(spark, p, cols))


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str], key: str | None = None, ids: DataFrame | Sequence | None = None) -> DataFrame:
    """Pruned Parquet read; a short id list becomes a pushed filter, a table of ids a semi join."""
    df = spark.read.parquet(path)
    wanted = list(dict.fromkeys([*columns, *([key] if key else [])]))
    df = df.select(*wanted)
    if ids is None:
        return df.select(*columns)
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key), key, "left_semi").select(*columns)
    if len(ids) > PUSHED_IDS:
        table = spark.createDataFrame([(i,) for i in ids], f"{key} {dict(df.dtypes)[key]}")
        return df.join(table, key, "left_semi").select(*columns)
    return df.filter(F.col(key).isin(list(ids))).select(*columns)


def attach_column(raw: DataFrame, pred: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Exactly one more column than the raw schema; rows are neither lost nor multiplied."""
    if column in raw.columns:
        raise ValueError(f"{column!r} is already a column")
    one = pred.groupBy(*keys).agg(F.max(column).alias(column), F.count(F.lit(1)).alias("_n"))
    twice = one.filter("_n > 1").take(1)
    if twice:
        raise ValueError(f"duplicate prediction key {twice[0].asDict()}")
    return raw.join(one.drop("_n"), list(keys), "left").select(*raw.columns, column)


def merge_channels(base: DataFrame, channels: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Several one-column frames onto one, each joined one to one."""
    out = base
    for name, frame in channels.items():
        out = attach_column(out, frame, keys, name)
    return out


def assign_predictions(index: DataFrame, preds: DataFrame, keys: Sequence[str], pred: str, order: str = "_order") -> DataFrame:
    """Predictions matched to the index by key; a duplicate or an unmatched row raises.

    The order column of the index is kept, so the caller can restore it when writing.
    """
    out = attach_column(index, preds, keys, pred)
    gaps = out.filter(F.col(pred).isNull()).count()
    if gaps:
        raise ValueError(f"{gaps} requested rows got no prediction: the forecast does not cover them")
    return out


def with_order(df: DataFrame, name: str = "_order") -> DataFrame:
    """Position of each row from 0: by file path, place of the split in its file, and row. ``df`` is a read of files;
    any other frame is numbered in its own partition order.

    Inside a split rows have consecutive numbers; a split starts where the rows of the splits before it end.
    """
    try:
        rows = df.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()})
        rows.schema  # noqa: B018 - resolves the file columns
    except AnalysisException:
        return df.withColumn(name, F.monotonically_increasing_id())
    splits = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    places = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    at = F.col("_base") + F.col("_row") - F.col("_first")
    return rows.join(places.drop("_n"), ["_file", "_start"]).withColumn(name, at.cast("long")).drop("_file", "_start", "_row", "_first", "_base")


def write_predictions(df: DataFrame, path: str, keys: Sequence[str], pred: str, order: str | None = None, *, one_file: bool = False) -> None:
    """CSV of the contract columns in index order.

    The sort is distributed and the part files are in order; ``one_file`` is for a small graded
    output only.
    """
    out = df.orderBy(order) if order else df.orderBy(*keys)
    out = out.select(*keys, pred)
    if one_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").csv(path, header=True)


def label_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column replaced by the 0-based code of its value in sort order."""
    out = df
    for c in columns:
        codes = ordered.sorted_codes(df, c, "_code")
        out = out.join(codes, c, "left").withColumn(c, F.col("_code")).drop("_code")
    return out.select(*df.columns)


def training_arrays(df: DataFrame, spec: PanelSpec, cut: int, covariates: Sequence[str]) -> DataFrame:
    """One row per series: target and covariates as float arrays in time order, rows before the cut.

    Series longer than one chunk come back as several rows numbered by ``part``.
    """
    cols = [spec.target, *covariates]
    rows = df.filter(F.col(spec.index) < cut).withColumn("part", F.floor(F.col(spec.index) / spec.chunk_rows))
    packed = F.array_sort(F.collect_list(F.struct(spec.index, *(F.col(c).cast("float").alias(c) for c in cols))))
    out = rows.groupBy(spec.id, "part").agg(packed.alias("_r"))
    return out.select(spec.id, "part", *(F.col(f"_r.{c}").alias(c) for c in cols))


