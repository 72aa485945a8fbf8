"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosine, components.

Vectors are compared only inside their label. Equal vectors of a label are one class with a count, so
copies make no pairs. A class has a key of ``bits`` signs per table; classes that share a key of any
table meet, at an angle of a cosine of 0.98 in at least one of the tables with probability
1 - (1 - 0.936 ** bits) ** tables. Two classes that meet in several tables are compared in the first
only, so links can be counted where they are found: a run gives out a count per row and one link
per row to the class it belongs to, never its pairs. Keys with very many classes are cut into
blocks. The cosine is exact, in double precision.

Nulls: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label,
link with nothing. Vectors of another length are never equal and never compared. Ties: a cosine of
exactly ``threshold`` links. Repeated rows are vectors of their own. A null ``vec_id`` never names a
component that has another, and is never kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import components, join_labels, paired_runs, pairs_in_runs, small_batches, whole_runs
from panelloom.session import checkpointed


def planes(size: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed + size).standard_normal((size, bits * tables))


def sign_keys(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One key per vector and table."""
    signs = (vectors @ planes(vectors.shape[1], bits, tables, seed) > 0).reshape(len(vectors), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def linked_classes(classes: DataFrame, threshold: float, bits: int, tables: int, seed: int, cap: int) -> DataFrame:
    """``cls``, ``other``, ``n``: for classes (cls, label, vec, copies) the copies of all linked classes, and a link
    to another class wherever one was found. Sums of ``n`` are exact; the links span the classes."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vec").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
                keys = sign_keys(matrix(rows.column("vec"), int(size)), bits, tables, seed)
                all_keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.astype(np.int32).ravel()), tables).cast(pa.list_(pa.int32()))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("cls"), rows.column("label"), rows.column("vec"), rows.column("copies"), all_keys, pa.array(np.full(len(keys), t, np.int32))],
                        names=["cls", "label", "vec", "copies", "keys", "tab"],
                    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, at_least=2_000):
            sizes = part.column("vec").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                rows = part.take(pa.array(np.flatnonzero(sizes == size)))
                cls, copies, tab, run, block, home = (rows.column(c).to_numpy() for c in ("cls", "copies", "tab", "run", "block", "home"))
                label = rows.column("label").to_numpy()
                vec, keys = matrix(rows.column("vec"), int(size)), matrix(rows.column("keys"), tables).astype(np.int64)
                norm = np.sqrt((vec * vec).sum(axis=1))
                found, root = np.zeros(len(cls), np.int64), np.arange(len(cls))
                for a, b in pairs_in_runs(run):
                    at = tab[a]
                    ok = (label[a] == label[b]) & (tab[b] == at) & (home[a] | (block[a] != block[b]))
                    same = keys[a] == keys[b]
                    ok &= same.argmax(axis=1) == at  # the first table in which they meet
                    ok &= same[np.arange(len(a)), at]
                    a, b = a[ok], b[ok]
                    ok = np.einsum("ij,ij->i", vec[a], vec[b]) / (norm[a] * norm[b]) >= threshold
                    a, b = a[ok], b[ok]
                    np.add.at(found, a, copies[b])
                    np.add.at(found, b, copies[a])
                    root = join_labels(root, a, b)
                out = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(cls[out]), pa.array(cls[root[out]]), pa.array(found[out])], names=["cls", "other", "n"])

    dealt = classes.mapInArrow(keyed, "cls long, label int, vec array<float>, copies long, keys array<int>, tab int")
    dealt = dealt.withColumn("cell", F.xxhash64("label", "tab", F.get("keys", F.col("tab"))))
    runs = paired_runs(dealt, "cell", ["cls"], cap, ["cls"])
    return runs.select("run", "block", "home", "cls", "label", "vec", "copies", "keys", "tab").mapInArrow(meet, "cls long, other long, n long")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, bits: int = 14, tables: int = 20, seed: int = 7, cap: int = 2_048) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept``: one row per vector."""
    small_batches(vectors.sparkSession)
    vec = F.col("embedding").cast("array<float>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))
    # a class is named by a 64-bit hash of label and vector: -0.0 counts as 0.0
    plain = F.transform(vec, lambda x: x + F.lit(0.0).cast("float"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), plain.alias("vec"), valid.alias("valid"))
    rows = rows.withColumn("cls", F.when(F.col("valid"), F.xxhash64("label", "vec")))
    classes = rows.filter("valid").groupBy("cls", "label").agg(F.any_value("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    classes = checkpointed(classes)
    found = checkpointed(linked_classes(classes.drop("least_id"), threshold, bits, tables, seed, cap))
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("cls").alias("src"), F.col("other").alias("dst")))
    named = (
        classes.select("cls", "copies", "least_id")
        .join(counts, "cls", "left")
        .join(roots, F.col("cls") == F.col("node"), "left")
        .select("cls", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least_id", F.coalesce("root", "cls").alias("root"))
    )
    # written before the join, so that a component of very many classes is a skewed side that can be split
    ids = checkpointed(named.groupBy("root").agg(F.min("least_id").alias("component_id")))
    final = named.join(ids, "root").select("cls", "n_links", "component_id")
    out = rows.select("vec_id", "cls").join(final, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
