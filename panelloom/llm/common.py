"""What the operators share: words, gapless numbers, hot keys, runs of equal keys, components.

Words are maximal runs of anything but space and the five ASCII controls from tab to carriage return.
"""

from __future__ import annotations

import gc
import math
import string
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelloom.session import checkpointed, shared_folder

SPACE = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def kept_table(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from there: lineage is cut, and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forget(kept: DataFrame) -> None:
    """Remove the files of a kept table that nothing reads any more, and let Spark drop the shuffles that made it.

    Spark drops shuffle files when the driver finds their plans unused, which may be long after; so it is asked to look.
    """
    jvm = kept.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(kept.kept_at)
    path.getFileSystem(kept.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows or 4 MB: texts may be long, and a task's memory should not follow them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def free_name(df: DataFrame, base: str) -> str:
    """``base`` with as many underscores as it takes not to clash with a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def number_within(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str, weight: str | None = None, per_bucket: int = 20_000) -> DataFrame:
    """Gapless numbers from 0 in every group, in the order of a hash of ``order``; no group is sorted in one task.

    Rows are dealt by the leading bits of the hash. Each bucket is numbered on its own, on top of the
    sum of the buckets before it. The bits follow the size of the input, the numbers do not depend
    on them. ``weight`` counts a row as so many. Group columns must not be null.
    """
    h, b, base, before = (free_name(df, n) for n in ("_hash", "_bucket", "_base", "_before"))
    df = df.withColumn(h, F.xxhash64(*order))
    bits = max(5, math.ceil(math.log2(max(1, df.count()) / per_bucket)))
    df = df.withColumn(b, F.shiftrightunsigned(F.col(h), 64 - bits))
    n = F.col(weight) if weight else F.lit(1).cast("long")
    keys = [*group, b]
    unsigned = F.col(h).bitwiseXOR(F.lit(-(2**63)))  # so that rows in a bucket and the buckets follow one order
    inside = Window.partitionBy(*keys).orderBy(unsigned, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = df.withColumn(before, F.sum(n).over(inside) - n)
    ahead = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum(n).alias(base)).withColumn(base, F.coalesce(F.sum(base).over(ahead), F.lit(0)))
    joined = numbered.join(sums, keys, "left")
    return joined.withColumn(out, (F.col(base) + F.col(before)).cast("long")).drop(h, b, base, before)


# ------------------------------------------------------------------ hot keys and runs of equal keys

HOT_KEYS_SENT = 100_000


def dealt_keys(df: DataFrame, key: str, spread: Sequence[str], cap: int) -> tuple[DataFrame, DataFrame]:
    """Keys with more than ``cap`` rows beside the number of blocks to split them into, and ``df`` with
    that number (1 for all other keys) and the block of each row."""
    hot = checkpointed(df.groupBy(key).count().filter(F.col("count") > cap).select(key, F.ceil(F.col("count") / cap).cast("int").alias("blocks")))
    few = hot.count() <= HOT_KEYS_SENT  # a checked size: beyond it the join shuffles
    dealt = df.join(F.broadcast(hot) if few else hot, key, "left")
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    return hot, dealt.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(*spread), blocks).cast("int"))


def paired_runs(df: DataFrame, key: str, spread: Sequence[str], cap: int, sort: Sequence[str]) -> DataFrame:
    """Rows dealt and sorted by ``run`` so that any two rows of one key meet in exactly one run.

    A key with up to ``cap`` rows is one run. A larger one is cut into blocks, and every two blocks
    meet in a run of their own, so no task gets a whole hot key. Two rows of one block would meet in
    each of its runs: ``home`` marks the run where they count.
    """
    _, dealt = dealt_keys(df, key, spread, cap)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other)
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    run = F.when(F.col("blocks") == 1, F.col(key)).otherwise(F.xxhash64(key, lo, hi))
    dealt = dealt.withColumn("run", run).withColumn("home", F.col("block") == F.col("other")).drop("blocks", "other")
    return dealt.repartition("run").sortWithinPartitions("run", *sort)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str = "run", at_least: int = 1) -> Iterator[pa.Table]:
    """Regroup the batches of a sorted partition so that no run of equal keys is cut."""
    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut == 0:
            continue
        yield pa.Table.from_batches([*kept[:-1], batch.slice(0, cut)])
        kept, rows = [batch.slice(cut)], batch.num_rows - cut
    if kept:
        yield pa.Table.from_batches(kept)


def pairs_in_runs(run: np.ndarray, limit: np.ndarray | None = None, reach: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one run, one distance in the order after the other, never all at once.

    With ``limit`` (ascending inside a run) only pairs whose limits differ by ``reach`` at most.
    """
    first = np.arange(len(run))
    step = 1
    while len(first):
        first = first[first + step < len(run)]
        second = first + step
        ok = run[first] == run[second]
        if limit is not None:
            ok &= limit[second] - limit[first] <= reach
        first = first[ok]
        if len(first):
            yield first, first + step
        step += 1


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of the rows ``a`` and ``b``; ``label[i]`` is the smallest row of i's class."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


# ------------------------------------------------------------------ connected components


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for every node of ``edges`` (src, dst) but the roots.

    Alternating large and small stars: each round replaces a node's links by links to the smallest
    neighbour. Minima are partial aggregates, so a node with very many links is no hot group in
    them, and the joins back are plain equi-joins whose skewed side adaptive execution splits.
    """
    e = checkpointed(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))




# ------------------------------------------------------------------ texts in tasks


def text_pieces(batch: pa.RecordBatch, text: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text, so that memory does not follow the batch."""
    size = np.cumsum(_lengths(batch.column(text)))
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def lower_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, A-Z in lower case, and where each text's words start (one more entry than texts)."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    lists = pc.ascii_split_whitespace(bare)
    counts = np.where(_lengths(bare) == 0, 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(lists)
    if len(flat) != counts.sum():
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    return flat, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: the sum of scrambled (byte, place) pairs. Words must not be empty."""
    if not len(flat):
        return np.empty(0, np.uint64)
    wide = np.int64 if pa.types.is_large_string(flat.type) else np.int32
    offsets = np.frombuffer(flat.buffers()[1], wide)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    data = np.frombuffer(flat.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    pair = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    pair <<= 8
    pair += data
    return mixed(np.add.reduceat(mixed(pair.view(np.uint64) + np.uint64(1)), offsets[:-1]))


class HashIndex:
    """Places of 64-bit numbers in a fixed list, by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], np.uint64(2**64 - 1))
        self.shift = np.uint64(64 - max(1, int(np.ceil(np.log2(len(keys) + 2)))))
        self.start = np.searchsorted(self.keys[:-1], np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each number, -1 where it is not in the list."""
        if len(self.keys) == 1:
            return np.full(len(wanted), -1)
        at = self.start.take((wanted >> self.shift).view(np.int64))
        late = np.flatnonzero(self.keys.take(at) < wanted)
        while len(late):
            at[late] += 1
            late = late[self.keys.take(at.take(late)) < wanted.take(late)]
        hit = (self.keys.take(at) == wanted) & (at < len(self.order))
        return np.where(hit, self.order.take(np.minimum(at, len(self.order) - 1)), -1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of SplitMix64)."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


def shingles(words_: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` words from each word on."""
    n = len(words_) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words_[i : i + n]
    return mixed(out)
