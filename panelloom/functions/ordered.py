"""Ordered per-series computation that does not put a whole long series into one task.

Every function here works on the 0-based position ``spec.index``. When ``spec.series_len`` proves
that a series fits one window partition, a plain window over the series is used. Otherwise the
series is cut into chunks of ``spec.chunk_rows`` positions:

* bounded frames (lags, rolling means) copy the few rows near a chunk edge into the neighbouring
  chunk, so a row is shuffled once plus its share of the edge;
* unbounded frames (fills, exponential memory) are computed inside each chunk, and one summary row
  per chunk carries the state across.

A series holding a third of all rows is therefore spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelloom.spec import PanelSpec

_HOME, _CHUNK = "_home", "_chunk"


def row_index(df: DataFrame, spec: PanelSpec, name: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """0-based row number within each series, by time."""
    name = name or spec.index
    keys = [*by, spec.id]
    if spec.bounded:
        w = Window.partitionBy(*keys).orderBy(spec.time)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    span = spec.step_seconds * spec.chunk_rows
    cut = df.withColumn(_CHUNK, F.floor(F.unix_seconds(F.col(spec.time)) / span))
    counts = cut.groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, _CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = Window.partitionBy(*keys, _CHUNK).orderBy(spec.time)
    return (
        cut.withColumn("_local", F.row_number().over(local) - 1)
        .join(starts, [*keys, _CHUNK])
        .withColumn(name, (F.col("_start") + F.col("_local")).cast("long"))
        .drop(_CHUNK, "_start", "_local")
    )


def over_index(
    df: DataFrame,
    spec: PanelSpec,
    *builds: Callable[[WindowSpec], dict[str, Column]],
    back: int = 0,
    ahead: int = 0,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most ``back`` rows behind and ``ahead`` in front.

    Several ``builds`` run one after another inside the same partitions, so a later one may read
    the columns of an earlier one. ``keys=()`` treats the frame as one single series (a system-wide series with one row per time).
    """
    keys = [spec.id] if keys is None else list(keys)
    if spec.bounded:
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(spec.index)
        for build in builds:
            df = df.withColumns(build(w))
        return df
    size = max(spec.chunk_rows, back, ahead)
    pos = F.pmod(F.col(spec.index), F.lit(size))
    home = F.floor(F.col(spec.index) / size)
    homes = [home]
    if back:
        homes.append(F.when(pos >= size - back, home + 1))
    if ahead:
        homes.append(F.when(pos < ahead, home - 1))
    spread = df.withColumn(_HOME, home).withColumn(_CHUNK, F.explode(F.array_compact(F.array(*homes))))
    w = Window.partitionBy(*keys, _CHUNK).orderBy(spec.index)
    for build in builds:
        spread = spread.withColumns(build(w))
    return spread.filter(F.col(_CHUNK) == F.col(_HOME)).drop(_HOME, _CHUNK)


def lagged(df: DataFrame, spec: PanelSpec, lags: dict[str, tuple[Column, int]], keys=None) -> DataFrame:
    """Shift expressions by whole rows; a negative shift looks ahead."""
    back = max([n for _, n in lags.values() if n > 0], default=0)
    ahead = max([-n for _, n in lags.values() if n < 0], default=0)
    return over_index(
        df, spec, lambda w: {name: F.lag(x, n).over(w) for name, (x, n) in lags.items()},
        back=back, ahead=ahead, keys=keys,
    )


def rolling_mean(
    df: DataFrame, spec: PanelSpec, means: dict[str, tuple[Column, int]], *, centred: bool, keys=None
) -> DataFrame:
    """Rolling means with at least one row; a centred window of even width leans backward.

    Every mean is added up over its own frame, so a value out of range spoils the windows that hold it and no other.
    """

    def frame(n: int) -> tuple[int, int]:
        return (n // 2, (n - 1) // 2) if centred else (n - 1, 0)

    reach = [frame(n) for _, n in means.values()]
    return over_index(
        df, spec,
        lambda w: {n: F.avg(x).over(w.rowsBetween(-frame(k)[0], frame(k)[1])) for n, (x, k) in means.items()},
        back=max(b for b, _ in reach), ahead=max(a for _, a in reach), keys=keys,
    )


def carried(
    df: DataFrame, spec: PanelSpec, values: dict[str, Column], *, backward: bool = False, keys=None
) -> DataFrame:
    """Last non-NULL value at or before each row, or with ``backward`` the next one at or after.

    Looking ahead is looking back in descending order: a frame open to the following side would be
    recomputed for every row.
    """
    keys = [spec.id] if keys is None else list(keys)

    def way(column: str):
        return F.col(column).desc() if backward else F.col(column).asc()

    def latest(x: Column, w: WindowSpec, to: int) -> Column:
        return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, to))

    if spec.bounded:
        w = Window.partitionBy(*keys).orderBy(way(spec.index))
        return df.withColumns({n: latest(x, w, 0) for n, x in values.items()})
    cut = df.withColumns(
        {_CHUNK: F.floor(F.col(spec.index) / spec.chunk_rows), **{f"_v_{n}": x for n, x in values.items()}}
    )
    w = Window.partitionBy(*keys, _CHUNK).orderBy(way(spec.index))
    edge = F.min_by if backward else F.max_by
    ends = cut.groupBy(*keys, _CHUNK).agg(
        *(
            edge(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.col(spec.index))).alias(f"_e_{n}")
            for n in values
        )
    )
    across = Window.partitionBy(*keys).orderBy(way(_CHUNK))
    carry = ends.select(*keys, _CHUNK, *(latest(F.col(f"_e_{n}"), across, -1).alias(f"_c_{n}") for n in values))
    out = cut.withColumns({n: latest(F.col(f"_v_{n}"), w, 0) for n in values}).join(carry, [*keys, _CHUNK], "left")
    out = out.withColumns({n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in values})
    return out.drop(_CHUNK, *(f"_v_{n}" for n in values), *(f"_c_{n}" for n in values))


def interpolated(df: DataFrame, spec: PanelSpec, cols: dict[str, Column], keys=None) -> DataFrame:
    """Linear interpolation by row position between observed rows; edges stay NULL."""
    i = F.col(spec.index)
    known = {n: F.when(x.isNotNull(), F.struct(i.alias("i"), x.alias("v"))) for n, x in cols.items()}
    out = df.withColumns({f"_k_{n}": s for n, s in known.items()})
    out = carried(out, spec, {f"_p_{n}": F.col(f"_k_{n}") for n in cols}, keys=keys)
    out = carried(out, spec, {f"_q_{n}": F.col(f"_k_{n}") for n in cols}, backward=True, keys=keys)

    def between(n: str) -> Column:
        p, q = F.col(f"_p_{n}"), F.col(f"_q_{n}")
        slope = (q["v"] - p["v"]) / F.nullif(q["i"] - p["i"], F.lit(0))
        return F.when(p["i"] == q["i"], p["v"]).otherwise(p["v"] + slope * (i - p["i"]))

    return out.withColumns({n: between(n) for n in cols}).drop(
        *(f"{t}{n}" for n in cols for t in ("_k_", "_p_", "_q_"))
    )


def ewma(
    df: DataFrame, spec: PanelSpec, cols: dict[str, tuple[Column, float]], keys=None
) -> DataFrame:
    """Recursive exponential mean ``s[t] = (1-a)*s[t-1] + a*x[t]``, ``a = 1 - 0.5**(1/h)``, ``s[0] = x[0]``.

    Solved as a rescaled prefix sum. Positions are taken relative to a chunk of at most 500
    half-lives so that the rescaling cannot overflow, and the state at the end of a chunk is carried
    into the next. Inputs must not be NULL.
    """
    keys = [spec.id] if keys is None else list(keys)
    sizes = sorted({min(spec.chunk_rows, max(1, int(500 * h))) for _, h in cols.values()})
    size = sizes[0]
    single = spec.series_len is not None and spec.series_len <= size
    i = F.col(spec.index)
    part = [*keys, _CHUNK]
    out = df.withColumn(_CHUNK, F.floor(i / size)).withColumn("_at", F.pmod(i, F.lit(size)).cast("double"))
    w = Window.partitionBy(*part).orderBy(spec.index).rowsBetween(Window.unboundedPreceding, 0)

    def term(x: Column, h: float) -> Column:
        return F.when(i == 0, x).otherwise(x * F.lit(1.0 - 0.5 ** (1.0 / h))) * F.pow(F.lit(2.0), F.col("_at") / h)

    out = out.withColumns({f"_t_{n}": term(x, h) for n, (x, h) in cols.items()})
    down = {n: F.pow(F.lit(2.0), -F.col("_at") / h) for n, (_, h) in cols.items()}
    local = out.withColumns({n: F.sum(f"_t_{n}").over(w) * down[n] for n in cols})
    scratch = [_CHUNK, "_at", *(f"_t_{n}" for n in cols)]
    if single:
        return local.drop(*scratch)
    sums = out.groupBy(*part).agg(*(F.sum(f"_t_{n}").alias(f"_s_{n}") for n in cols))
    carry = _carried_states(sums, keys, size, {n: h for n, (_, h) in cols.items()})
    joined = local.join(carry, part, "left")
    return joined.withColumns({n: F.col(n) + F.coalesce(f"_c_{n}", F.lit(0.0)) * down[n] for n in cols}).drop(
        *scratch, *(f"_c_{n}" for n in cols)
    )


def _carried_states(sums: DataFrame, keys: Sequence[str], size: int, halflives: dict[str, float]) -> DataFrame:
    """What enters each chunk from all chunks before it: ``_c_name`` from the chunk sums ``_s_name``.

    The same prefix sum one level up, over runs of chunks that span at most 500 half-lives: running sums inside a
    run, and the last state of the run before. What lies further back has faded by 2 ** -500 and counts as nothing. A row
    per chunk is all that is sorted, and no row holds more than its own chunk.
    """
    c = F.col(_CHUNK)
    whole = Window.partitionBy(*keys).orderBy(_CHUNK)
    done = sums
    for n, h in halflives.items():
        run = max(1, int(500 * h) // size)
        place = F.pmod(c, F.lit(run)).cast("double")
        step = size / h
        inside = Window.partitionBy(*keys, F.floor(c / run)).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, 0)
        ends = F.sum(F.col(f"_s_{n}") * F.pow(F.lit(2.0), place * step)).over(inside) * F.pow(F.lit(2.0), -place * step)
        done = done.withColumn(f"_l_{n}", ends)
    for n, h in halflives.items():
        run = max(1, int(500 * h) // size)
        earlier = whole_runs_before(keys, run)
        place = F.pmod(c, F.lit(run)).cast("double")
        state = F.col(f"_l_{n}") + F.coalesce(F.last(f"_l_{n}").over(earlier), F.lit(0.0)) * F.pow(F.lit(2.0), -(place + 1) * (size / h))
        done = done.withColumn(f"_e_{n}", state * F.lit(2.0 ** (-size / h)))
    entering = {f"_c_{n}": F.lag(f"_e_{n}").over(whole) for n in halflives}
    return done.withColumns(entering).select(*keys, _CHUNK, *entering)


def whole_runs_before(keys: Sequence[str], run: int):
    """The chunks of all runs before a chunk's own."""
    return Window.partitionBy(*keys).orderBy(F.floor(F.col(_CHUNK) / run)).rangeBetween(Window.unboundedPreceding, -1)


def global_index(df: DataFrame, keys: Sequence[str], name: str = "pos") -> DataFrame:
    """Dense 0-based numbering of all rows without a single-task sort.

    Rows are ordered by the first three hex digits of a digest of their keys, then by the keys:
    4,096 buckets, each numbered on its own and offset by the sizes of the buckets before it.
    """
    tag = F.substring(F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in keys))), 1, 3)
    cut = df.withColumn("_bucket", tag)
    sizes = cut.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = Window.partitionBy("_bucket").orderBy(*keys)
    return (
        cut.withColumn("_local", F.row_number().over(local) - 1)
        .join(F.broadcast(starts), "_bucket")  # at most 4,096 rows
        .withColumn(name, (F.col("_start") + F.col("_local")).cast("long"))
        .drop("_bucket", "_local", "_start")
    )


def sorted_codes(df: DataFrame, col: str, name: str = "code", splits: int = 255) -> DataFrame:
    """Distinct values of ``col`` numbered 0.. in sort order: (col, code).

    Up to ``splits`` values, picked by hash, cut the value range into buckets; each bucket is
    numbered on its own and offset by the ones below it, so no task sorts all values.
    """
    values = df.select(col).filter(F.col(col).isNotNull()).distinct()
    marks = sorted(r[0] for r in values.orderBy(F.xxhash64(col), col).limit(splits).collect())
    if not marks:
        return values.withColumn(name, F.lit(0).cast("long"))
    cut = values.withColumn("_b", F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m <= F.col(col))))
    sizes = cut.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy(col)) - 1
    return (
        cut.withColumn("_local", local)
        .join(F.broadcast(starts), "_b")  # at most splits + 1 rows
        .select(col, (F.col("_start") + F.col("_local")).cast("long").alias(name))
    )
