"""Convex blending of members, weight searches and amplitude recalibration.

All fits minimise pooled absolute error. A candidate weight is one conditional sum in a single
aggregation over the cube, so a grid costs one pass; nothing is multiplied by the grid size.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations, permutations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions import metrics as M
from panelloom.functions.exprs import clip, ratio
from panelloom.operators.index import bag_columns
from panelloom.session import checkpointed
from panelloom.spec import PanelSpec

# Fixed value: stretch of a blend around its own mean.
DESMOOTH_GAMMA = 1.04
WEIGHT_TOL = 1e-6
SHRINK_GRID = tuple(i / 10 for i in range(11))
GAMMA_GRID = tuple(round(0.90 + 0.01 * i, 2) for i in range(31))
# Candidate sums per aggregation: more of them would not compile to one method.
BATCH = 48


def grid(n: int = 101) -> list[float]:
    return [i / (n - 1) for i in range(n)]


def weighted_text(weights: Mapping[str, float]) -> str:
    return " + ".join(f"{float(w)!r}D * `{m}`" for m, w in weights.items())


def weighted_sum(weights: Mapping[str, float]) -> Column:
    return F.expr(weighted_text(weights))


def convex(weights: Mapping[str, float]) -> Column:
    """Blend at given weights; weights that do not sum to 1 are refused."""
    total = sum(weights.values())
    if abs(total - 1.0) > WEIGHT_TOL:
        raise ValueError(f"blend weights sum to {total}, not 1")
    return weighted_sum(weights)


Candidate = str | Column


def _abs_sum(y: str, candidate: Candidate, name: str) -> Column:
    if isinstance(candidate, str):
        return F.expr(f"sum(abs(`{y}` - ({candidate})))").alias(name)
    return F.sum(F.abs(F.col(y) - candidate)).alias(name)


def scores(df: DataFrame, y: str, candidates: Mapping[str, Candidate], keys: Sequence[str]) -> DataFrame:
    """Absolute error sum of each candidate per key, with the shared denominator ``ya``."""
    sums = [_abs_sum(y, c, n) for n, c in candidates.items()]
    out = df.groupBy(*keys).agg(F.sum(F.abs(y)).alias("ya"), *sums[:BATCH])
    for i in range(BATCH, len(sums), BATCH):
        out = out.join(df.groupBy(*keys).agg(*sums[i : i + BATCH]), list(keys))
    return out


def totals(df: DataFrame, y: str, candidates: Mapping[str, Candidate]) -> dict[str, float]:
    """The same sums over all rows, read on the driver: one number per candidate and ``ya``."""
    sums = [F.sum(F.abs(y)).alias("ya"), *(_abs_sum(y, c, n) for n, c in candidates.items())]
    out: dict[str, float] = {}
    for i in range(0, len(sums), BATCH):
        out |= df.agg(*sums[i : i + BATCH]).first().asDict()
    return out


def _best(values: Sequence[float], names: Sequence[str]) -> Column:
    """Struct (score, value) of the lowest sum; the first grid point wins a tie."""
    return F.array_min(
        F.array(*(F.struct(F.col(n).alias("ae"), F.lit(float(v)).alias("value")) for v, n in zip(values, names)))
    )


def grid_best(df: DataFrame, spec: PanelSpec, values: Sequence[float], pred) -> tuple[float, float]:
    """The grid value with the lowest pooled error over all rows, and that error."""
    sums = totals(df, spec.target, {f"_g{i}": pred(v) for i, v in enumerate(values)})
    ae, j = min((sums[f"_g{i}"], i) for i in range(len(values)))
    return float(values[j]), ae / sums["ya"]


def grid_fit(df: DataFrame, spec: PanelSpec, values: Sequence[float], pred, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: the grid value with the lowest pooled error (``pred(v)`` is the prediction at ``v``)."""
    if not keys:
        return df.sparkSession.createDataFrame([grid_best(df, spec, values, pred)], "value double, fit_wape double")
    names = [f"_g{i}" for i in range(len(values))]
    table = scores(df, spec.target, {n: pred(v) for n, v in zip(names, values)}, keys)
    best = table.select(*keys, "ya", _best(values, names).alias("_b"))
    return best.select(*keys, F.col("_b.value").alias("value"), ratio(F.col("_b.ae"), F.col("ya")).alias("fit_wape"))


def pair(a: str, b: str):
    return lambda w: weighted_sum({a: w, b: 1.0 - w})


def pair_text(a: str, b: str):
    return lambda w: weighted_text({a: w, b: 1.0 - w})


def pair_curve(df: DataFrame, spec: PanelSpec, a: str, b: str, points: int = 101) -> DataFrame:
    """WAPE at every weight of ``w*a + (1-w)*b``: (w, wape)."""
    ws = grid(points)
    sums = totals(df, spec.target, {f"_g{i}": pair_text(a, b)(w) for i, w in enumerate(ws)})
    rows = [(w, sums[f"_g{i}"] / sums["ya"]) for i, w in enumerate(ws)]
    return df.sparkSession.createDataFrame(rows, "w double, wape double")


def pair_report(df: DataFrame, spec: PanelSpec, a: str, b: str, points: int = 101) -> DataFrame:
    """Weight fitted on early rows and scored on late ones, beside the oracle weight and its cost."""
    early, late = df.filter(F.col("blk") < spec.late_from), df.filter(F.col("blk") >= spec.late_from)
    w, _ = grid_best(early, spec, grid(points), pair_text(a, b))
    oracle, oracle_wape = grid_best(late, spec, grid(points), pair_text(a, b))
    y = F.col(spec.target)
    row = late.agg(
        M.wape(y, pair(a, b)(w)).alias("late_fitted"), M.wape(y, F.col(a)).alias("late_a"), M.wape(y, F.col(b)).alias("late_b")
    )
    return row.select(
        F.lit(w).alias("weight"), F.lit(oracle).alias("oracle_weight"), "late_fitted", F.lit(oracle_wape).alias("late_oracle"),
        "late_a", "late_b", (F.col("late_fitted") - F.lit(oracle_wape)).alias("selection_cost"),
    )


def gap_refit(df: DataFrame, spec: PanelSpec, a: str, b: str, points: int = 101) -> DataFrame:
    """Weight fitted on the gap half of the horizon, clipped at zero, scored on the scored half."""
    def clipped(w: float) -> str:
        return f"greatest(0D, {pair_text(a, b)(w)})"

    w, fit_wape = grid_best(df.filter(~F.col("is_scored")), spec, grid(points), clipped)
    return df.filter("is_scored").agg(
        F.lit(w).alias("weight"), F.lit(fit_wape).alias("fit_wape"), M.wape(F.col(spec.target), F.expr(clipped(w))).alias("score_wape")
    )


# ---------------------------------------------------------------- simplex by exact line searches


@dataclass(frozen=True)
class Line:
    """Blends ``(w + g * d)`` of the members at places ``cols``, for g from 0 to 1."""

    cols: tuple[int, ...]
    w: np.ndarray
    d: np.ndarray


def _narrow(df: DataFrame, y: Column, members: Sequence[Column]) -> DataFrame:
    return df.select(y.cast("double").alias("_y"), *(m.cast("double").alias(f"_m{i}") for i, m in enumerate(members)))


def _matrices(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labels and members (a column each), nulls as NaN, few enough rows at a time that ``cells`` values a row stay small."""
    rows = max(1, 2_000_000 // max(1, cells))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            cols = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.slice(start, rows).columns]
            yield cols[0], np.stack(cols[1:], axis=1)


def _grid_errors(df: DataFrame, sets: Sequence[tuple[tuple[int, ...], np.ndarray]]) -> list[np.ndarray]:
    """Absolute error sums of all weight vectors (rows of a matrix) of all member sets, in one pass over the rows.

    ``df`` is a table of :func:`_narrow`. A row whose label or a member of the set is null counts for nothing in it.
    """
    ends = np.cumsum([0, *(len(w) for _, w in sets)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ends[-1])
        for y, x in _matrices(batches, max(len(w) for _, w in sets)):
            for lo, hi, (cols, w) in zip(ends, ends[1:], sets):
                total[lo:hi] += np.nansum(np.abs(y[:, None] - x[:, cols] @ w.T), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "ae"])

    got = df.mapInArrow(each, "k long, ae double").groupBy("k").agg(F.sum("ae").alias("ae")).toArrow()
    out = np.zeros(ends[-1])
    out[got.column("k").to_numpy()] = got.column("ae").to_numpy()
    return [out[lo:hi] for lo, hi in zip(ends, ends[1:])]


def _ratios(y: np.ndarray, x: np.ndarray, line: Line) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's error is zero on the line, and how fast it grows from there; rows the line does not change are left out."""
    part = x[:, line.cols]
    d = part @ line.d
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (y - part @ line.w) / d
    used = (d != 0) & ~np.isnan(t)
    return t[used], np.abs(d[used])


def line_minima(df: DataFrame, lines: Sequence[Line], bins: int = 1024, exact_below: int = 20_000) -> list[float]:
    """The g in [0, 1] with the lowest absolute error on every line: weighted medians, all found in the same passes.

    Each pass adds up a histogram per open line inside the tasks and narrows the line's range to the bin that holds its
    median, until the bin is one value or has at most ``exact_below``, which are read. Passes do not grow with the lines,
    and only histograms are shuffled. ``df`` is a table of :func:`_narrow`.
    """
    found: dict[int, float] = {}
    lo, hi, below, half = [0.0] * len(lines), [1.0] * len(lines), [0.0] * len(lines), [0.0] * len(lines)
    few: set[int] = set()
    first = True
    while todo := [k for k in range(len(lines)) if k not in found and k not in few]:

        def each(batches: Iterator[pa.RecordBatch], todo=tuple(todo), lo=tuple(lo), hi=tuple(hi), first=first) -> Iterator[pa.RecordBatch]:
            n = bins + 2
            w, rows = np.zeros((len(todo), n)), np.zeros((len(todo), n), np.int64)
            low, high = np.full((len(todo), n), np.inf), np.full((len(todo), n), -np.inf)
            for y, x in _matrices(batches, 16):
                for i, k in enumerate(todo):
                    t, d = _ratios(y, x, lines[k])
                    if not first:
                        inside = (t >= lo[k]) & (t <= hi[k])
                        t, d = t[inside], d[inside]
                    at = np.floor((t - lo[k]) / ((hi[k] - lo[k]) / bins))
                    slot = (np.clip(at, -1, bins) if first else np.clip(at, 0, bins - 1)).astype(np.int64) + 1
                    w[i] += np.bincount(slot, d, n)
                    rows[i] += np.bincount(slot, minlength=n)
                    np.minimum.at(low[i], slot, t)
                    np.maximum.at(high[i], slot, t)
            i, slot = np.nonzero(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(todo)[i]), pa.array(slot - 1), pa.array(w[i, slot]), pa.array(rows[i, slot]), pa.array(low[i, slot]), pa.array(high[i, slot])],
                names=["k", "b", "w", "n", "first", "last"],
            )

        tally = df.mapInArrow(each, "k long, b long, w double, n long, first double, last double").groupBy("k", "b")
        got = tally.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).collect()
        by_line: dict[int, list] = {k: [] for k in todo}
        for row in got:
            by_line[row["k"]].append(row)
        for k, bars in by_line.items():
            bars.sort(key=lambda r: r["b"])
            if first:
                half[k] = 0.5 * sum(r["w"] for r in bars)
            if not half[k]:
                found[k] = 0.0
                continue
            hit = bars[-1]
            for row in bars:
                if below[k] + row["w"] >= half[k]:
                    hit = row
                    break
                below[k] += row["w"]
            if hit["b"] < 0:
                found[k] = 0.0
            elif hit["b"] >= bins:
                found[k] = 1.0
            elif hit["last"] - hit["first"] < 1e-300:
                found[k] = hit["first"]
            else:
                lo[k], hi[k] = hit["first"], hit["last"]
                if hit["n"] <= exact_below:
                    few.add(k)
        first = False
    if few:
        left = sorted(few)

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for y, x in _matrices(batches, 16):
                for k in left:
                    t, d = _ratios(y, x, lines[k])
                    inside = (t >= lo[k]) & (t <= hi[k])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(inside.sum(), k)), pa.array(t[inside]), pa.array(d[inside])], names=["k", "t", "w"])

        got = df.mapInArrow(values, "k long, t double, w double").toArrow()  # at most ``exact_below`` rows a line
        line, t, w = (got.column(c).to_numpy() for c in ("k", "t", "w"))
        for k in left:
            order = np.argsort(t[line == k], kind="stable")
            mine, sums = t[line == k][order], below[k] + np.cumsum(w[line == k][order])
            found[k] = float(mine[min(np.searchsorted(sums, half[k]), len(mine) - 1)])
    return [min(1.0, max(0.0, found[k])) for k in range(len(lines))]


def _steps_curve(df: DataFrame, r: Column, d: Column, bins: int = 1024, exact_below: int = 20_000) -> float:
    """Exact minimiser of ``sum |r - g*d|`` over g in [0, 1]: the weighted median of r/d."""
    return line_minima(_narrow(df, r, [d]), [Line((0,), np.zeros(1), np.ones(1))], bins, exact_below)[0]


def _directions(w: np.ndarray, probes: np.ndarray) -> Iterator[np.ndarray]:
    """Moves from ``w`` that stay convex up to their full length: between two members, to and away from one, and along ``probes``."""
    n = len(w)
    for a, b in permutations(range(n), 2):
        if w[b] > 0:
            d = np.zeros(n)
            d[a], d[b] = w[b], -w[b]
            yield d
    for k in range(n):
        if w[k] < 1:
            to = -w
            to[k] += 1
            yield to
            if w[k] > 0:
                yield -to * (w[k] / (1 - w[k]))
    for d in probes:
        shrinks = d < 0
        if shrinks.any():
            reach = float(np.min(w[shrinks] / -d[shrinks]))
            if reach > 0:
                yield d * reach


def fit_simplexes(df: DataFrame, spec: PanelSpec, sets: Sequence[Sequence[str]], steps: int = 12, points: int = 2_000, probes: int = 6) -> list[dict[str, float]]:
    """Convex weights with the lowest absolute error for every set of members, all sets in the same passes.

    Two members are one exact line search. More start at the best point of a grid (the finest with at most ``points``
    points). A step searches exactly along all pairs of members, to and away from each member and along ``probes``
    seeded directions that are new in every step, so that a kink of the error does not hold it; every set then moves to
    its best point. A move is made only if it lowers the error, so the result is never worse than the grid. A set is
    done after two steps without a gain. Jobs grow with the steps, not with the sets, members or lines. A row with a null label
    or a null in a member of the set counts for nothing in it. The columns that are needed are written once.
    """
    names = list(dict.fromkeys(m for c in sets for m in c))
    cols = [tuple(names.index(m) for m in c) for c in sets]
    rows = checkpointed(_narrow(df, F.col(spec.target), [F.col(m) for m in names]))
    best: list[np.ndarray] = [np.ones(1)] * len(sets)
    two = [k for k, c in enumerate(cols) if len(c) == 2]
    for k, g in zip(two, line_minima(rows, [Line(cols[k], np.array([0.0, 1.0]), np.array([1.0, -1.0])) for k in two]) if two else ()):
        best[k] = np.array([g, 1.0 - g])
    todo = [k for k, c in enumerate(cols) if len(c) > 2]
    error, idle = {}, dict.fromkeys(todo, 0)
    if todo:
        starts = []
        for k in todo:
            n = len(cols[k])
            parts = max((i for i in range(1, 21) if comb(i + n - 1, i) <= points), default=1)
            starts.append(np.array([list(w.values()) for w in simplex_grid(range(n), parts)]))
        for k, w, e in zip(todo, starts, _grid_errors(rows, [(cols[k], w) for k, w in zip(todo, starts)])):
            best[k], error[k] = w[e.argmin()], float(e.min())
    rng = np.random.default_rng(1)
    for _ in range(steps):
        if not todo:
            break
        lines, owner = [], []
        for k in todo:
            made = rng.normal(size=(probes, len(cols[k])))
            for d in _directions(best[k], made - made.mean(axis=1, keepdims=True)):
                lines.append(Line(cols[k], best[k], d))
                owner.append(k)
        ends = [line.w + g * line.d for line, g in zip(lines, line_minima(rows, lines))]
        tried = []
        for k in todo:
            w = np.maximum(np.array([e for e, o in zip(ends, owner) if o == k]), 0.0)
            tried.append(w / w.sum(axis=1, keepdims=True))
        for k, w, e in zip(todo, tried, _grid_errors(rows, [(cols[k], w) for k, w in zip(todo, tried)])):
            gained = error[k] - float(e.min())
            idle[k] = 0 if gained > 1e-9 * error[k] else idle[k] + 1
            if gained > 0:
                best[k], error[k] = w[e.argmin()], float(e.min())
        todo = [k for k in todo if idle[k] < 2]
    return [dict(zip(c, map(float, w))) for c, w in zip(sets, best)]


def fit_simplex(df: DataFrame, spec: PanelSpec, members: Sequence[str], steps: int = 12, points: int = 2_000) -> dict[str, float]:
    """As :func:`fit_simplexes`, for one set of members."""
    return fit_simplexes(df, spec, [list(members)], steps, points)[0]


def simplex_grid(members: Sequence[str], parts: int) -> list[dict[str, float]]:
    """All weight vectors with the given denominator."""
    def split(n: int, left: int):
        if n == 1:
            yield (left,)
            return
        for i in range(left + 1):
            for rest in split(n - 1, left - i):
                yield (i, *rest)

    return [{m: x / parts for m, x in zip(members, v)} for v in split(len(members), parts)]


def combinations_of(members: Sequence[str], sizes: Sequence[int]) -> list[tuple[str, ...]]:
    return [c for n in sizes for c in combinations(members, n)]


def search_grid(df: DataFrame, spec: PanelSpec, members: Sequence[str], sizes: Sequence[int] = (2, 3), parts: int = 20) -> DataFrame:
    """Every member combination: best grid weights on early rows, scored on late ones, the best of a size first.

    Candidates are sums, ``BATCH`` of them per pass over the rows.
    """
    early, late = df.filter(F.col("blk") < spec.late_from), df.filter(F.col("blk") >= spec.late_from)
    fits = [(c, simplex_grid(c, parts)) for c in combinations_of(members, sizes)]
    cands = {f"_s{i}_{j}": weighted_text(w) for i, (_, ws) in enumerate(fits) for j, w in enumerate(ws)}
    row = totals(early, spec.target, cands)
    chosen = []
    for i, (c, ws) in enumerate(fits):
        j = min(range(len(ws)), key=lambda k: (row[f"_s{i}_{k}"], k))
        chosen.append((c, ws[j]))
    held = totals(late, spec.target, {f"_c{i}": weighted_text(w) for i, (_, w) in enumerate(chosen)})
    out = [
        ("+".join(c), len(c), [float(w[m]) for m in c], held[f"_c{i}"] / held["ya"]) for i, (c, w) in enumerate(chosen)
    ]
    out.sort(key=lambda x: (sizes.index(x[1]), x[3], x[0]))
    return df.sparkSession.createDataFrame(out, "members string, size long, weights array<double>, late_wape double")


def search_simplex(df: DataFrame, spec: PanelSpec, members: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """As ``search_grid`` with exact weights: one :func:`fit_simplexes` for all combinations."""
    early, late = df.filter(F.col("blk") < spec.late_from), df.filter(F.col("blk") >= spec.late_from)
    sets = combinations_of(members, sizes)
    fits = list(zip(sets, fit_simplexes(early, spec, sets)))
    held = totals(late, spec.target, {f"_c{i}": weighted_text(w) for i, (_, w) in enumerate(fits)})
    out = [("+".join(c), len(c), [w[m] for m in c], held[f"_c{i}"] / held["ya"]) for i, (c, w) in enumerate(fits)]
    out.sort(key=lambda x: (sizes.index(x[1]), x[3], x[0]))
    return df.sparkSession.createDataFrame(out, "members string, size long, weights array<double>, late_wape double")


# ---------------------------------------------------------------- combiners and assembly


def seed_bag(df: DataFrame, model: str, name: str) -> DataFrame:
    cols = bag_columns(df.columns, model)
    if not cols:
        raise ValueError(f"no column of model {model!r} among {df.columns}")
    return df.withColumn(name, sum((F.col(c) for c in cols), F.lit(0.0)) / F.lit(float(len(cols))))


def combiners(members: Sequence[str]) -> dict[str, Column]:
    """Row-wise mean, median and geometric mean of the members."""
    n = len(members)
    ordered_values = F.array_sort(F.array(*members))
    low, high = ordered_values[(n - 1) // 2], ordered_values[n // 2]
    logs = sum((F.log(F.greatest(F.col(m), F.lit(1e-9))) for m in members), F.lit(0.0))
    return {
        "mean": sum((F.col(m) for m in members), F.lit(0.0)) / F.lit(float(n)),
        "median": (low + high) / 2,
        "geomean": F.exp(logs / n),
    }


def best_member_per_series(df: DataFrame, spec: PanelSpec, members: Sequence[str]) -> DataFrame:
    """The member with the lowest error per series, and that error: the per-series oracle."""
    table = scores(df, spec.target, {f"_e_{m}": F.col(m) for m in members}, [spec.id])
    best = F.array_min(F.array(*(F.struct(F.col(f"_e_{m}").alias("ae"), F.lit(m).alias("member")) for m in members)))
    return table.select(spec.id, best.alias("_b"), "ya").select(spec.id, "_b.member", "_b.ae", "ya")


def desmooth(df: DataFrame, keys: Sequence[str], pred: str, gamma: float = DESMOOTH_GAMMA, name: str | None = None) -> DataFrame:
    """Stretch around each series' own mean prediction, then clip at zero; no label is read."""
    anchor = df.groupBy(*keys).agg(F.avg(pred).alias("_a"))
    p, a = F.col(pred), F.col("_a")
    return df.join(anchor, list(keys)).withColumn(name or pred, clip(a + F.lit(gamma) * (p - a), low=0.0)).drop("_a")


def gamma_fit(df: DataFrame, spec: PanelSpec, pred: str, keys: Sequence[str] = (), values: Sequence[float] = GAMMA_GRID) -> DataFrame:
    """Best stretch on early rows and its error on late rows; ``keys=(id,)`` fits one per series."""
    anchor = df.groupBy("cutoff", spec.id).agg(F.avg(pred).alias("_a"))
    rows = df.join(anchor, ["cutoff", spec.id])

    def at(g) -> Column:
        scale = g if isinstance(g, Column) else F.lit(float(g))
        return clip(F.col("_a") + scale * (F.col(pred) - F.col("_a")), low=0.0)

    early, late = rows.filter(F.col("blk") < spec.late_from), rows.filter(F.col("blk") >= spec.late_from)
    if keys:
        late = late.join(grid_fit(early, spec, values, at, keys).withColumnRenamed("value", "gamma"), list(keys))
    else:
        late = late.withColumn("gamma", F.lit(grid_best(early, spec, values, at)[0]))
    y = F.col(spec.target)
    return late.agg(
        F.min("gamma").alias("gamma_min"), F.max("gamma").alias("gamma_max"),
        M.wape(y, F.col(pred)).alias("late_before"), M.wape(y, at(F.col("gamma"))).alias("late_after"),
    )


def choose_rung(present: Sequence[str], rungs: Sequence[tuple[str, Mapping[str, float]]]) -> tuple[str, Mapping[str, float]]:
    """The first rung whose members are all present; each rung has its own weights."""
    have = set(present)
    for name, weights in rungs:
        if set(weights) <= have:
            if abs(sum(weights.values()) - 1.0) > WEIGHT_TOL:
                raise ValueError(f"rung {name!r}: weights sum to {sum(weights.values())}")
            return name, weights
    raise ValueError(f"no rung can run with members {sorted(have)}")


def structured_weights(df: DataFrame, spec: PanelSpec, a: str, b: str, group: Column, points: int = 101, lambdas: Sequence[float] = SHRINK_GRID) -> DataFrame:
    """Weights per group shrunk toward the global one: one row per lambda with its late error.

    lambda = 1 is the global weight, lambda = 0 the free group weights.
    """
    rows = df.withColumn("_grp", group)
    early, late = rows.filter(F.col("blk") < spec.late_from), rows.filter(F.col("blk") >= spec.late_from)
    overall, _ = grid_best(early, spec, grid(points), pair_text(a, b))
    own = grid_fit(early, spec, grid(points), pair_text(a, b), ["_grp"]).select("_grp", F.col("value").alias("_w"))
    scored = late.join(own, "_grp", "left").withColumn("_w", F.coalesce("_w", F.lit(overall)))

    def at(lam: float) -> Column:
        w = F.lit(lam) * F.lit(overall) + F.lit(1.0 - lam) * F.col("_w")
        return w * F.col(a) + (1 - w) * F.col(b)

    sums = totals(scored, spec.target, {f"_l{i}": at(x) for i, x in enumerate(lambdas)})
    table = [(float(x), sums[f"_l{i}"] / sums["ya"], overall) for i, x in enumerate(lambdas)]
    return df.sparkSession.createDataFrame(table, "shrink double, late_wape double, global_weight double")


def combination_means(df: DataFrame, spec: PanelSpec, members: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """WAPE of the plain mean of every member combination, from one aggregation."""
    combos = combinations_of(members, sizes)
    means = {f"_c{i}": weighted_text({m: 1.0 / len(c) for m in c}) for i, c in enumerate(combos)}
    sums = totals(df, spec.target, means)
    rows = [("+".join(c), len(c), sums[f"_c{i}"] / sums["ya"]) for i, c in enumerate(combos)]
    return df.sparkSession.createDataFrame(rows, "members string, size long, wape double")
