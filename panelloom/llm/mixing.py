"""Interleaving sources by target weights as a Pfair schedule.

The rows of a source are cut into blocks. Block k (from 1) of a source with share w of the slots has
release time floor((k - 1) / w) and deadline ceil(k / w), and each slot goes to the released block
with the earliest deadline. With shares that add up to one this never misses a deadline, so at any
time a source is less than one block away from its share.

Shares are the exact ratios of the weights, as whole numbers, so the bound holds against the weights
themselves for as long as a phase lasts. The driver walks the slots in constant memory and keeps, every
``period`` slots, how many blocks each source has had; tasks lay out each such window again from there, and
every block finds its slot by a join. When a source has no block left, the schedule goes on
with the others at their weights among themselves, as a new phase. Nothing is dropped or repeated.

Nulls: a null source is a source of its own. A source without a weight, or with a null or negative one, is
refused. Weight zero: such sources come last, by their sizes. Repeated rows stay rows of their own.
An empty table gives an empty result. The last block of a source may be short.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import free_name, kept_table, number_within

PERIOD = 1_000
MAX_SOURCES = 100_000


def shares(weights: Mapping[int, float], period: int = 0) -> dict[int, int]:
    """Whole numbers in the exact ratio of the weights; ``period`` does not change them."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*whole.values())
    return {s: n // common for s, n in whole.items()}


def turns(slots: Mapping[int, int], done: Mapping[int, int], t: int) -> Iterator[int]:
    """The source of each slot from ``t`` on, earliest deadline first among the released blocks, after ``done`` blocks of each."""
    size, done = sum(slots.values()), dict(done)
    waiting: dict[int, list[int]] = {}
    for s, n in slots.items():
        waiting.setdefault(max(t, done[s] * size // n), []).append(s)
    ready: list[tuple[int, int]] = []
    while True:
        for s in waiting.pop(t, ()):
            heapq.heappush(ready, (-(-(done[s] + 1) * size // slots[s]), s))
        _, s = heapq.heappop(ready)
        yield s
        done[s] += 1
        t += 1
        waiting.setdefault(max(t, done[s] * size // slots[s]), []).append(s)


def windows(blocks: Mapping[int, int], weights: Mapping[int, float], period: int) -> Iterator[tuple]:
    """The schedule as windows of up to ``period`` slots: first slot, slots of the phase before it, slots, the weights of the live
    sources, their blocks before the phase, their blocks in it before the window."""
    rest = {s: n for s, n in blocks.items() if n > 0}
    used, clock = dict.fromkeys(rest, 0), 0
    while rest:
        live = {s: float(weights[s]) for s in rest if weights[s] > 0} or {s: float(rest[s]) for s in rest}
        done, t, ended = dict.fromkeys(live, 0), 0, False
        turn = turns(shares(live), done, 0)
        while not ended:
            start, length = dict(done), 0
            while length < period and not ended:
                s = next(turn)
                done[s] += 1
                length += 1
                ended = done[s] == rest[s]
            yield clock, t, length, live, {s: used[s] for s in live}, start
            clock, t = clock + length, t + length
        for s, n in done.items():
            used[s] += n
            rest[s] -= n
            if not rest[s]:
                del rest[s]


def laid_out(t: int, length: int, live: Mapping[int, float], start: Mapping[int, int]) -> dict[int, list[int]]:
    """The places in a window of the blocks of each source, in their order."""
    places: dict[int, list[int]] = {}
    for at, s in enumerate(itertools.islice(turns(shares(live), start, t), length)):
        places.setdefault(s, []).append(at)
    return places


def phases(blocks: Mapping[int, int], weights: Mapping[int, float], period: int) -> list[tuple]:
    """The whole schedule as rows (source, first block, end block, places in the window, how many, slots of the window, first slot):
    block k of [first, end) of a source stands at ``slot0 + places[k - first]``."""
    out = []
    for clock, t, length, live, used, start in windows(blocks, weights, period):
        for s, places in laid_out(t, length, live, start).items():
            first = used[s] + start[s]
            out.append((s, first, first + len(places), places, len(places), length, clock))
    return out


WINDOW = "clock long, t long, length int, live array<int>, weight array<double>, used array<long>, start array<long>"


def schedule(spark: SparkSession, blocks: Mapping[int, int], weights: Mapping[int, float], period: int) -> DataFrame:
    """``of``, ``block``, ``slot``: one row per block; windows are laid out in tasks. ``of`` is the number of the source."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in batch.to_pylist():
                start = dict(zip(w["live"], w["start"]))
                used = dict(zip(w["live"], w["used"]))
                of, block, slot = [], [], []
                for s, places in laid_out(w["t"], w["length"], dict(zip(w["live"], w["weight"])), start).items():
                    of += [s] * len(places)
                    block += range(used[s] + start[s], used[s] + start[s] + len(places))
                    slot += [w["clock"] + p for p in places]
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(block, pa.int64()), pa.array(slot, pa.int64())], names=["of", "block", "slot"])

    period = max(period, 16 * len(blocks))  # a window has a row of all live sources
    rows = [(clock, t, length, list(live), list(live.values()), list(used.values()), list(start.values())) for clock, t, length, live, used, start in windows(blocks, weights, period)]
    many = max(1, min(len(rows), spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(rows, WINDOW).repartition(many, "clock").mapInArrow(each, "of int, block long, slot long")


def mix(df: DataFrame, source: str, order: list[str], weights: DataFrame | None = None, block_rows: int = 16, period: int = PERIOD, out: str = "position") -> DataFrame:
    """``df`` with ``source_row``, ``block``, ``slot`` and the ``out`` position in the mixture: slot times
    ``block_rows`` plus the place in the block, so positions skip where the last block of a source is short.

    ``weights`` has columns ``source`` and ``weight``; without it sources weigh the square root of
    their rows. Rows of a source come in the order of a hash of ``order``, so a source is well mixed in
    itself and no source is sorted in one task. The driver sees one row per source and keeps one per window.
    Columns of ``df`` that have the names of the four are replaced.
    """
    spark = df.sparkSession
    key = free_name(df, "_source")
    unnull = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))  # noqa: E731  a null source is a key too
    named = df.withColumn(key, unnull(F.col(source)))
    sizes = named.groupBy(key).agg(F.count("*").alias("n"))
    weighed = sizes.withColumn("w", F.sqrt(F.col("n").cast("double")))
    if weights is not None:
        given = weights.select(unnull(F.col("source")).alias("given"), F.col("weight").cast("double").alias("w"))
        weighed = sizes.join(given, F.col(key) == F.col("given"), "left").select(key, "n", "w")
    found = weighed.orderBy(key).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mix groups of sources")
    if any(r["w"] is None or not r["w"] >= 0 for r in found):
        raise ValueError("every source needs a weight of at least zero")
    counts = {i: -(-r["n"] // block_rows) for i, r in enumerate(found)}
    at, step = free_name(df, "_at"), free_name(df, "_step")
    plan = kept_table(schedule(spark, counts, {i: r["w"] for i, r in enumerate(found)}, period), "mixing-schedule")
    names = spark.createDataFrame([(i, r[key]) for i, r in enumerate(found)], "of int, name string")
    plan = plan.join(F.broadcast(names), "of").select(F.col("name").alias(at), F.struct("block", "slot").alias(step))
    numbered = number_within(named, [key], order, "source_row").withColumn("block", F.floor(F.col("source_row") / block_rows))
    hit = (F.col(key) == F.col(at)) & (F.col("block") == F.col(step)["block"])
    placed = numbered.join(plan, hit).withColumn("slot", F.col(step)["slot"])
    position = F.col("slot") * block_rows + F.col("source_row") % block_rows
    return placed.withColumn(out, position.cast("long")).drop(key, at, step)
