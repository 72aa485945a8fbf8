"""SimHash fingerprints, and all links up to a Hamming distance by a grid join over segment bit counts.

A fingerprint of 64 bits is mapped to the bit counts of its 32 two-bit segments. The Manhattan
distance of two such vectors never exceeds the Hamming distance, so links lie within ``distance`` in
it. The 32 coordinates are cut into ``distance + 2`` groups: two vectors at Manhattan distance
``distance`` or less agree exactly in at least two whole groups. The cells of the grid are therefore
the pairs of groups with their coordinates; inside a cell rows are ordered by their total bit count,
whose difference is again a lower bound, and only rows within ``distance`` of it are compared. What
is left is verified exactly on all 64 bits.

Equal fingerprints are one row throughout. Cells that hold very many fingerprints are cut into
blocks, and every two blocks meet in a run of their own. A run does not give out its pairs but the
classes they make, at most one link per row, so a dense group costs no more rows than it has.

Nulls: a null or blank text has no shingles and fingerprint zero, linked like any other. Ties: a bit set in
exactly half the shingles is 0. Repeated rows share a fingerprint and so a component; a null
``doc_id`` never names a component unless the whole component has none. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import arrow_schema, components, join_labels, paired_runs, pairs_in_runs, small_batches, whole_runs
from panelloom.session import checkpointed

SEED = 42
PIECE = 1 << 16


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the shingles of a text; a shorter text is one shingle, an empty one has none."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    line, ends = b" ".join(w), list(itertools.accumulate(map(len, w), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), PIECE):
        bits = np.unpackbits(hashes[i : i + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    over = counts * 2 > len(hashes)
    return int.from_bytes(np.packbits(over).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a signed long) of each document."""
    schema = arrow_schema("key long, fp long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes((x.as_py() or "").encode(), width)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], schema=schema)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(each, "key long, fp long")


PAIR_COUNTS = np.array([0, 1, 1, 2], np.int64)


def grid_cells(fp: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """The cells of each fingerprint: for every two groups of segments, their bit counts packed in a key."""
    segments = (fp[:, None] >> (2 * np.arange(32, dtype=np.uint64))[None, :]) & np.uint64(3)
    counts = PAIR_COUNTS[segments.astype(np.int64)]
    groups = np.array_split(np.arange(32), distance + 2)
    packed = [(counts[:, g] * 3 ** np.arange(len(g))).sum(axis=1) for g in groups]
    for i, (a, b) in enumerate(itertools.combinations(range(len(groups)), 2)):
        yield i, packed[a] * 3 ** len(groups[b]) + packed[b]


def links(fps: DataFrame, distance: int = 4, cap: int = 4_096) -> DataFrame:
    """``src``, ``dst``: links between distinct fingerprints ``fp`` that make the classes of all pairs within ``distance``."""
    pairs = (distance + 2) * (distance + 1) // 2

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            fp = own.view(np.uint64)
            total = np.bitwise_count(fp).astype(np.int32)
            for i, cell in grid_cells(fp, distance):
                yield pa.RecordBatch.from_arrays([pa.array(cell * pairs + i), pa.array(own), pa.array(total)], names=["cell", "fp", "total"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, at_least=50_000):
            run, own, total = (part.column(c).to_numpy() for c in ("run", "fp", "total"))
            fp = own.view(np.uint64)
            label = np.arange(len(fp))
            for a, b in pairs_in_runs(run, total, distance):
                near = np.bitwise_count(fp[a] ^ fp[b]) <= distance
                label = join_labels(label, a[near], b[near])
            linked = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(own[linked]), pa.array(own[label[linked]])], names=["src", "dst"])

    grid = fps.select("fp").distinct().mapInArrow(cells, "cell long, fp long, total int")
    return paired_runs(grid, "cell", ["fp"], cap, ["total"]).select("run", "fp", "total").mapInArrow(meet, "src long, dst long").distinct()


def simhash_components(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``: one row per document."""
    small_batches(docs.sparkSession)
    fps = checkpointed(fingerprints(docs, width))
    distinct = fps.groupBy("fp").agg(F.min("key").alias("least_key"))
    roots = components(links(distinct, distance))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_key", F.coalesce("root", "fp").alias("root"))
    # written before the join, so that a component of very many fingerprints is a skewed side that can be split
    ids = checkpointed(named.groupBy("root").agg(F.min("least_key").alias("component_id")))
    classes = named.join(ids, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(classes, "fp").select(F.col("key").alias("doc_id"), hexed.alias("fingerprint"), "component_id")
