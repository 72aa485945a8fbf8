"""Boosted trees grown from histograms, every pass over the rows being one Spark job.

Rows are quantised once: a feature becomes the number of its bin edges below the value, with a bin of its own for what
is missing; the one category keeps its codes, however many there are. Blocks of binned rows stay in the shared
folder with the forecast so far. A pass sums the gradients of the rows of all open leaves by (leaf, feature, bin)
inside each task; the sums of a leaf then meet in one task, which returns its best split. A leaf's best split moves,
like no other part of the sums, to the driver, which grows the tree.

Gradients and weights are rounded to whole multiples of a power of two small enough for all sums to be exact. Sums are
then the same in any order: trees depend neither on the partitions nor on lost executors.

* :func:`fit`: leaves are split best first up to ``leaves``. Leaves whose turn may come are opened together, so a tree takes
  about as many passes as it has levels. Splits on the category put the codes in the order of their mean gradient.
* ``symmetric``: one split per level for all leaves, the one with the largest summed gain; a leaf's number has one bit per
  level. The category counts by its mean target.
* Under absolute loss, leaves are refitted to the weighted median of what is left over (the smallest value at which half the
  weight is reached), narrowed over passes until one value is left or what is left spans less than ``narrow`` of all residuals.

Results: rows without target or weight, or with weight zero, take no part. Without any row the forecast is zero. A missing
value (NULL or NaN) goes where the split put the missing, or to the larger side if there were none; so does
an unseen category to the right. Ties: the first feature, the lowest bin, missing to the right.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.session import checkpointed

#: Rows read for the bin edges, chosen by a hash of their keys; all rows are binned.
EDGE_ROWS = 50_000
#: A range of residuals is cut into so many parts when a median is narrowed.
PARTS = 1 << 15
#: Rows of a task at least, where there are so many.
TASK_ROWS = 150_000
#: Rounds after which the forecast so far is written to the blocks.
KEPT_ROUNDS = 5
#: Sums stay below 2 ** 52, so that float additions of whole numbers are exact.
EXACT_BITS = 52
LOSSES = ("absolute", "squared")


@dataclass(frozen=True)
class Bins:
    """How values become codes. ``category`` is the place of the category among the features; ``level`` its mean
    target by code where it counts as a number."""

    features: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    category: int | None = None
    codes: int = 0
    level: np.ndarray | None = None

    @property
    def widths(self) -> list[int]:
        """Codes of each feature, the last one for missing; none for a category of its own."""
        return [0 if i == self.category and self.level is None else len(e) + 2 for i, e in enumerate(self.edges)]

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.widths)]).astype(np.int64)

    def bin(self, columns: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
        """Codes by feature and row, and the category's codes (-1 for none)."""
        n = len(columns[0]) if columns else 0
        out, unit = np.zeros((len(columns), n), np.uint8), None
        for i, (values, edges) in enumerate(zip(columns, self.edges)):
            values = np.asarray(values, np.float64)
            if i == self.category:
                unit = np.where(np.isfinite(values) & (values >= 0) & (values < self.codes), values, -1).astype(np.int64)
                if self.level is None:
                    continue
                values = np.where(unit >= 0, self.level[unit], np.nan) if self.codes else np.full(n, np.nan)
            out[i] = np.where(np.isnan(values), len(edges) + 1, np.searchsorted(edges, values, side="left"))
        return out, unit


@dataclass
class Tree:
    """Nodes as arrays; a leaf has ``feature`` -1. Rows with a code up to ``code`` go left. ``sides`` has the codes of a category that go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    code: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])
    sides: dict[int, np.ndarray] = field(default_factory=dict)

    def split(self, node: int, feature: int, code: int, missing_left: bool, side: np.ndarray | None) -> tuple[int, int]:
        self.feature[node], self.code[node], self.missing_left[node] = feature, code, missing_left
        if side is not None:
            self.sides[node] = side
        children = len(self.feature), len(self.feature) + 1
        self.left[node], self.right[node] = children
        for _ in children:
            for column, empty in ((self.feature, -1), (self.code, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.depth, self.depth[node] + 1)):
                column.append(empty)
        return children

    def leaves(self, codes: np.ndarray, unit: np.ndarray | None, missing: np.ndarray) -> np.ndarray:
        """The leaf of each row. ``missing`` is the code of a missing value by feature."""
        feature, code, toward = np.array(self.feature), np.array(self.code), np.array(self.missing_left)
        left, right = np.array(self.left), np.array(self.right)
        node = np.zeros(codes.shape[1], np.int64)
        live = np.arange(len(node)) if self.feature[0] >= 0 else np.empty(0, np.int64)
        while len(live):
            at = node[live]
            f = feature[at]
            own = codes[f, live]
            goes = np.where(own == missing[f], toward[at], own <= code[at])
            for split_node, side in self.sides.items():
                mine = np.flatnonzero(at == split_node)
                if len(mine):
                    u = unit[live[mine]]
                    goes[mine] = np.where(u >= 0, side[u], False)
            at = np.where(goes, left[at], right[at])
            node[live] = at
            live = live[feature[at] >= 0]
        return node


@dataclass(frozen=True)
class SymmetricTree:
    """One split per level; bit k of a leaf's number says which side of split k it is on."""

    feature: tuple[int, ...]
    code: tuple[int, ...]
    missing_left: tuple[bool, ...]
    value: tuple[float, ...]

    def leaves(self, codes: np.ndarray, unit: np.ndarray | None, missing: np.ndarray) -> np.ndarray:
        out = np.zeros(codes.shape[1], np.int64)
        for k, (f, c, toward) in enumerate(zip(self.feature, self.code, self.missing_left)):
            own = codes[f]
            right = own > c
            if toward:
                right &= own != missing[f]
            out |= right.astype(np.int64) << k
        return out


@dataclass(frozen=True)
class Forest:
    """A fitted model: the start, and trees over binned rows."""

    bins: Bins
    start: float
    step: float
    trees: tuple

    @property
    def missing(self) -> np.ndarray:
        return np.array([len(e) + 1 for e in self.bins.edges])

    def values(self, codes: np.ndarray, unit: np.ndarray | None, trees: Sequence | None = None) -> np.ndarray:
        """What the trees add up to."""
        out = np.zeros(codes.shape[1])
        for tree in self.trees if trees is None else trees:
            out += self.step * np.array(tree.value)[tree.leaves(codes, unit, self.missing)]
        return out

    def predict(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        codes, unit = self.bins.bin(columns)
        return self.start + self.values(codes, unit)


def forecast(forest: Forest, rows: DataFrame, out: str) -> DataFrame:
    """``rows`` with the forecast ``out``; features are read as doubles."""

    @F.pandas_udf("double")
    def scored(*columns):
        import pandas as pd

        return pd.Series(forest.predict([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns]))

    if not forest.bins.features:
        return rows.withColumn(out, F.lit(forest.start))
    return rows.withColumn(out, scored(*(F.col(c).cast("double") for c in forest.bins.features)))


# ---------------------------------------------------------------- binned rows


def learn_bins(rows: DataFrame, features: Sequence[str], most: int, key: Column, count: int, category: str | None = None, target: str | None = None) -> Bins:
    """Edges at equal shares of the rows read for them. With ``target`` the category counts by its mean of it."""
    if not 2 <= most <= 254:
        raise ValueError(f"{most} bins: between 2 and 254 are possible")
    category = category if category in features else None
    numbers = [c for c in features if c != category]
    thin = max(1, math.ceil(count / EDGE_ROWS))
    some = rows.filter(F.pmod(key, F.lit(thin)) == 0) if thin > 1 else rows
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in numbers))) if numbers else None
    edges: dict[str, np.ndarray] = {}
    if numbers:
        long = some.select(cells.alias("e")).select("e.c", "e.v").filter("v IS NOT NULL AND NOT isnan(v)")
        marks = F.array(*(F.lit(i / most) for i in range(1, most)))
        for r in long.groupBy("c").agg(F.percentile("v", marks).alias("m"), F.max("v").alias("top")).collect():
            found = np.unique(np.array(r["m"], np.float64))
            edges[r["c"]] = found[found < r["top"]]
    codes, level = 0, None
    if category:
        codes = (rows.agg(F.max(category)).first()[0] or -1) + 1
        if target:
            level = np.full(int(codes), np.nan)
            for r in rows.filter(F.col(category).isNotNull()).groupBy(F.col(category).cast("long").alias("u")).agg(F.avg(F.round(F.col(target), 9).cast("decimal(28,9)")).cast("double").alias("m")).collect():
                level[r["u"]] = r["m"]
            known = np.unique(level[~np.isnan(level)])
            edges[category] = known[:-1] if len(known) <= most else np.unique(np.quantile(known, np.arange(1, most) / most, method="lower"))
    empty = np.empty(0)
    return Bins(tuple(features), tuple(edges.get(c, empty) for c in features), list(features).index(category) if category else None, int(codes), level)


BLOCK = "n int, codes binary, unit binary, y binary, w binary, f binary, key binary"


def pack(rows: DataFrame, bins: Bins, target: str, weight: str, key: Column) -> DataFrame:
    """Blocks of binned rows, one per Arrow batch, with a forecast of zero."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(BLOCK))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            codes, unit = bins.bin(columns[3:])
            cells = [codes.tobytes(), unit.astype(np.int32).tobytes() if unit is not None else b"", *(c.astype(np.float64).tobytes() for c in columns[:2]), np.zeros(n).tobytes(), columns[2].astype(np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], schema=schema)

    known = rows.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")) & (F.col(weight) > 0))
    double = lambda c: F.col(c).cast("double")
    features = [double(c).alias(f"_x{i}") for i, c in enumerate(bins.features)]
    return known.select(double(target).alias("_y"), double(weight).alias("_w"), key.alias("_key"), *features).mapInArrow(each, BLOCK)


class Block:
    """One row of the packed table as arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int, features: int):
        cell = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)
        self.n = batch.column("n")[i].as_py()
        self.codes = cell("codes", np.uint8).reshape(features, self.n)
        unit = cell("unit", np.int32)
        self.unit = unit if len(unit) else None
        self.y, self.w, self.f = (cell(c, np.float64) for c in "ywf")
        self.key = cell("key", np.uint64)


def blocks_of(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch, i, features)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of SplitMix64)."""
    y = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    y = (y ^ (y >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return y ^ (y >> np.uint64(31))


@dataclass(frozen=True)
class Round:
    """What a pass needs to know of the rows: the trees not yet in the blocks, the loss, the share of rows and the unit of exact sums."""

    forest: Forest
    recent: tuple
    loss: str
    share: float
    seed: int
    unit: float

    def residual(self, b: Block) -> np.ndarray:
        return b.y - (self.forest.start + b.f + self.forest.values(b.codes, b.unit, self.recent))

    def sampled(self, b: Block) -> np.ndarray:
        if self.share >= 1:
            return np.ones(b.n, bool)
        return scrambled(b.key + np.uint64(self.seed)) < np.uint64(int(self.share * 2**63) * 2)

    def gradients(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        r = self.residual(b)
        g = -np.sign(r) * b.w if self.loss == "absolute" else -r * b.w
        return np.rint(g / self.unit), np.maximum(np.rint(b.w / self.unit), 1.0)


# ---------------------------------------------------------------- splits


def _gain(left: np.ndarray, total: np.ndarray, least: int) -> np.ndarray:
    """How much better two leaves fit than one; ``left`` has sums (gradient, weight, rows) per candidate."""
    right = total - left
    ok = (left[:, 2] >= least) & (right[:, 2] >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[:, 0] ** 2 / left[:, 1] + right[:, 0] ** 2 / right[:, 1] - total[0] ** 2 / total[1]
    return np.where(ok, gain, -np.inf)


def candidates(sums: np.ndarray, missing_left: bool) -> np.ndarray:
    """Sums to the left of every code of a feature; the last row of ``sums`` are the missing."""
    left = np.cumsum(sums[:-1], axis=0)
    return left + sums[-1] if missing_left else left


def best_number(sums: np.ndarray, bins: Bins, allowed: Sequence[int], least: int) -> tuple | None:
    """(gain, feature, code, missing left, sums to the left) of the best split on a number of one leaf."""
    best = None
    for f in allowed:
        lo, hi = bins.offsets[f], bins.offsets[f + 1]
        if hi - lo < 2:
            continue
        own = sums[lo:hi]
        total = own.sum(axis=0)
        for toward in (False, True) if own[-1, 2] else (None,):
            left = candidates(own, bool(toward))
            gain = _gain(left, total, least)
            at = int(np.argmax(gain))
            if gain[at] > 1e-9 * max(1.0, total[1]) and (best is None or gain[at] > best[0]):
                larger = bool(2 * left[at, 2] > total[2]) if toward is None else toward
                best = float(gain[at]), f, at, larger, left[at]
    return best


def best_category(sums: np.ndarray, least: int) -> tuple | None:
    """(gain, codes that go left, sums to the left) of the best split of one leaf on the category."""
    held = np.flatnonzero(sums[:, 2] > 0)
    if len(held) < 2:
        return None
    order = held[np.lexsort((held, sums[held, 0] / sums[held, 1]))]
    left = np.cumsum(sums[order], axis=0)[:-1]
    total = sums[order].sum(axis=0)
    gain = _gain(left, total, least)
    at = int(np.argmax(gain))
    if not gain[at] > 1e-9 * max(1.0, total[1]):
        return None
    side = np.zeros(len(sums), bool)
    side[order[: at + 1]] = True
    return float(gain[at]), side, left[at]


PARTIAL = "slot int, part int, sums binary"
SPLIT = "slot int, part int, gain double, feature int, code int, missing_left boolean, side binary, lefts binary, totals binary"


def partial_sums(blocks: DataFrame, now: Round, tree, slots: dict[int, int], allowed: Sequence[int]) -> DataFrame:
    """Sums of (gradient, weight, rows) by leaf, feature and code inside each task: part 0 all numbers, part 1 the category."""
    bins = now.forest.bins
    offsets, features = bins.offsets, len(bins.features)
    own_category = bins.category is not None and bins.level is None and bins.category in allowed
    numbers = [f for f in allowed if not (f == bins.category and bins.level is None)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = len(slots), int(offsets[-1])
        lookup = None
        sums = np.zeros((3, n, total))
        units = np.zeros((3, n, bins.codes)) if own_category else None
        for b in blocks_of(batches, features):
            node = tree.leaves(b.codes, b.unit, now.forest.missing) if tree is not None else np.zeros(b.n, np.int64)
            if lookup is None or len(lookup) <= node.max(initial=0):
                lookup = np.full(int(max(max(slots, default=0), node.max(initial=0))) + 1, -1)
                lookup[list(slots)] = list(slots.values())
            slot = lookup[node]
            use = np.flatnonzero((slot >= 0) & now.sampled(b))
            if not len(use):
                continue
            g, h = now.gradients(b)
            slot, weights = slot[use], (g[use], h[use], None)
            for f in numbers:
                width = int(offsets[f + 1] - offsets[f])
                at = slot * width + b.codes[f][use]
                for k, x in enumerate(weights):
                    sums[k, :, offsets[f] : offsets[f + 1]] += np.bincount(at, x, n * width).reshape(n, width)
            if own_category:
                u = b.unit[use]
                ok = u >= 0
                at = slot[ok] * bins.codes + u[ok]
                for k, x in enumerate(weights):
                    units[k] += np.bincount(at, None if x is None else x[ok], n * bins.codes).reshape(n, bins.codes)
        rows = [(s, 0, np.ascontiguousarray(sums[:, s].T).tobytes()) for s in range(n) if sums[2, s].any()]
        if own_category:
            rows += [(s, 1, np.ascontiguousarray(units[:, s].T).tobytes()) for s in range(n) if units[2, s].any()]
        columns = list(zip(*rows)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], names=["slot", "part", "sums"])

    return blocks.mapInArrow(each, PARTIAL)


def added(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], np.ndarray]:
    """The partial sums of each (leaf, part) added up."""
    out: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for slot, part, cell in zip(*(batch.column(c).to_pylist() for c in ("slot", "part", "sums"))):
            sums = np.frombuffer(cell, np.float64).reshape(-1, 3)
            out[slot, part] = out[slot, part] + sums if (slot, part) in out else sums
    return out


def met(partial: DataFrame, parts: int, *keys: str) -> DataFrame:
    """The rows of a leaf together in one task, as they are where there is only one."""
    return partial.repartition(*keys) if parts > 1 else partial


def best_splits(blocks: DataFrame, parts: int, now: Round, tree: Tree, open_: Sequence[int], allowed: Sequence[int], least: int) -> dict[int, tuple | None]:
    """The best split of each open leaf: (gain, feature, code, missing left, side, sums left, sums in all), or None."""
    bins = now.forest.bins
    slots = {node: s for s, node in enumerate(open_)}
    numbers = [f for f in allowed if not (f == bins.category and bins.level is None)]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for (slot, part), sums in added(batches).items():
            if part == 0:
                first = next((f for f in numbers if bins.widths[f]), None)
                total = sums[bins.offsets[first] : bins.offsets[first + 1]].sum(axis=0) if first is not None else np.zeros(3)
                found = best_number(sums, bins, numbers, least)
                if found:
                    rows.append((slot, part, *found[:4], b"", found[4].tobytes(), total.tobytes()))
            else:
                found = best_category(sums, least)
                if found:
                    rows.append((slot, part, found[0], bins.category, 0, False, np.packbits(found[1]).tobytes(), found[2].tobytes(), sums.sum(axis=0).tobytes()))
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        columns = list(zip(*rows)) or [[]] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in SPLIT.split(", ")])

    partial = partial_sums(blocks, now, tree, slots, allowed)
    found = met(partial, parts, "slot", "part").mapInArrow(choose, SPLIT).collect()
    out: dict[int, tuple | None] = dict.fromkeys(open_)
    for r in sorted(found, key=lambda r: (r["slot"], -r["gain"], r["part"]), reverse=True):
        side = np.unpackbits(np.frombuffer(r["side"], np.uint8), count=bins.codes).astype(bool) if r["part"] == 1 else None
        out[open_[r["slot"]]] = (r["gain"], r["feature"], r["code"], r["missing_left"], side, np.frombuffer(r["lefts"], np.float64), np.frombuffer(r["totals"], np.float64))
    return out


def grow(blocks: DataFrame, parts: int, now: Round, allowed: Sequence[int], leaves: int, depth: int, least: int) -> tuple[Tree, dict[int, np.ndarray]]:
    """A tree split best first, and the sums of its leaves where they are known.

    Leaves that would be split if their children turn out no better are opened in one pass. When the order of splits no longer
    meets an unopened leaf, it is the order that opening one by one would have given.
    """
    tree, found, sums = Tree(), {}, {}
    pending = [0]
    while True:
        open_ = [node for node in pending if tree.depth[node] < depth]
        found |= dict.fromkeys(pending) | (best_splits(blocks, parts, now, tree, open_, allowed, least) if open_ else {})
        heap = [(-found[0][0], 0)] if found[0] else []
        chosen, opened, n = [], [], 1
        while heap and n < leaves:
            _, node = heapq.heappop(heap)
            chosen.append(node)
            n += 1
            if tree.feature[node] < 0:
                opened.append(node)
                continue
            for child in (tree.left[node], tree.right[node]):
                if found[child]:
                    heapq.heappush(heap, (-found[child][0], child))
        if not opened:
            break
        pending = []
        for node in opened:
            _, feature, code, toward, side, left, total = found[node]
            children = tree.split(node, feature, code, toward, side)
            sums |= dict(zip(children, (left, total - left)))
            pending += children
    for node in set(range(len(tree.feature))) - set(chosen):
        tree.feature[node] = -1  # opened, but not split in the end
        tree.sides.pop(node, None)
    return tree, sums


def grow_symmetric(blocks: DataFrame, parts: int, now: Round, allowed: Sequence[int], depth: int, least: int) -> tuple[SymmetricTree, dict[int, np.ndarray]]:
    """A tree with one split per level. The driver sees the sums of at most 2 ** depth leaves by feature and code."""
    bins = now.forest.bins
    feature, code, toward = [], [], []
    sums: dict[int, np.ndarray] = {}
    for level in range(depth):
        tree = SymmetricTree(tuple(feature), tuple(code), tuple(toward), ())
        slots = {leaf: leaf for leaf in range(1 << level)}

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [(slot, part, x.tobytes()) for (slot, part), x in added(batches).items()]
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], names=["slot", "part", "sums"])

        partial = partial_sums(blocks, now, tree, slots, allowed)
        got = {r["slot"]: np.frombuffer(r["sums"], np.float64).reshape(-1, 3) for r in met(partial, parts, "slot", "part").mapInArrow(total, PARTIAL).collect()}
        best = None
        for f in allowed:
            lo, hi = bins.offsets[f], bins.offsets[f + 1]
            for missing_left in (False, True):
                gain = np.zeros(hi - lo - 1)
                usable = np.zeros(hi - lo - 1, bool)
                for own in (got[s][lo:hi] for s in sorted(got)):
                    each = _gain(candidates(own, missing_left), own.sum(axis=0), least)
                    fits = each > 0
                    gain[fits] += each[fits]
                    usable |= fits
                if not usable.any():
                    continue
                at = int(np.argmax(gain))
                if best is None or gain[at] > best[0]:
                    best = gain[at], f, at, missing_left
        if best is None:
            break
        _, f, at, missing_left = best
        lo, hi = bins.offsets[f], bins.offsets[f + 1]
        sums = {}
        for s, x in got.items():
            left = candidates(x[lo:hi], missing_left)[at]
            sums |= {s: left, s | 1 << level: x[lo:hi].sum(axis=0) - left}
        feature.append(f)
        code.append(at)
        toward.append(missing_left)
    return SymmetricTree(tuple(feature), tuple(code), tuple(toward), ()), sums


# ---------------------------------------------------------------- leaf values


NARROWED = "leaf int, place binary, weight binary, low binary, high binary"
FOUND = "leaf int, low double, high double, below double, total double"


def medians(blocks: DataFrame, parts: int, now: Round, tree, span: tuple[float, float], narrow: float) -> dict[int, float]:
    """The weighted median of what is left over in each leaf: the smallest value at which half the weight is reached.

    A pass cuts each leaf's range into parts and keeps the part that holds the median, until the part is one value.
    """
    features = len(now.forest.bins.features)
    slack = 1e-9 * (1 + abs(span[0]) + abs(span[1]))  # sums of trees are rounded
    span = span[0] - slack, span[1] + slack
    state: dict[int, tuple[float, float, float, float | None]] = {}
    out: dict[int, float] = {}
    everyone = True
    while everyone or state:
        known = dict(state)

        def tally(batches: Iterator[pa.RecordBatch], known=known, everyone=everyone) -> Iterator[pa.RecordBatch]:
            got: dict[int, list[tuple]] = {}
            for b in blocks_of(batches, features):
                node = tree.leaves(b.codes, b.unit, now.forest.missing)
                use = now.sampled(b)
                r, w = now.residual(b), np.maximum(np.rint(b.w / now.unit), 1.0)
                size = int(node.max(initial=0)) + 1
                low, high = np.full(size, span[0] if everyone else np.inf), np.full(size, span[1] if everyone else -np.inf)
                for leaf, (a, z, _, _) in known.items():
                    if leaf < size:
                        low[leaf], high[leaf] = a, z
                use &= (r >= low[node]) & (r <= high[node])
                node, r, w = node[use], r[use], w[use]
                width = (high[node] - low[node]) / PARTS
                place = np.minimum((r - low[node]) / np.where(width > 0, width, 1.0), PARTS - 1).astype(np.int64)
                cell = node * PARTS + place
                order = np.lexsort((r, cell))
                cell, r, w = cell[order], r[order], w[order]
                if not len(cell):
                    continue
                first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                last = np.append(first[1:], len(cell)) - 1
                leaf = cell[first] // PARTS
                for k in np.unique(leaf):
                    m = leaf == k
                    got.setdefault(int(k), []).append((cell[first][m] % PARTS, np.add.reduceat(w, first)[m], r[first][m], r[last][m]))
            rows = [(k, *(np.concatenate(c).tobytes() for c in zip(*merged([parts])))) for k, parts in got.items()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["leaf", "place", "weight", "low", "high"])

        def pick(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            got: dict[int, list[tuple]] = {}
            for batch in batches:
                for leaf, *cells in zip(*(batch.column(c).to_pylist() for c in ("leaf", "place", "weight", "low", "high"))):
                    got.setdefault(leaf, []).append((np.frombuffer(cells[0], np.int64), *(np.frombuffer(c, np.float64) for c in cells[1:])))
            rows = []
            for leaf, parts in got.items():
                place, weight, low, high = merged([parts])[0]
                _, _, below, total = known.get(leaf, (0.0, 0.0, 0.0, None))
                total = float(weight.sum()) if total is None else total
                ends = below + np.cumsum(weight)
                at = min(int(np.searchsorted(ends, total / 2)), len(ends) - 1)
                rows.append((leaf, float(low[at]), float(high[at]), float(ends[at] - weight[at]), total))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.float64()) for c in columns[1:])], names=["leaf", "low", "high", "below", "total"])

        found = met(blocks.mapInArrow(tally, NARROWED), parts, "leaf").mapInArrow(pick, FOUND).collect()
        state = {}
        for r in found:
            if r["high"] - r["low"] <= narrow * (span[1] - span[0]):
                out[r["leaf"]] = r["low"]
            else:
                state[r["leaf"]] = (r["low"], r["high"], r["below"], r["total"])
        everyone = False
    return out


def merged(lists: Sequence[list[tuple]]) -> list[tuple[np.ndarray, ...]]:
    """Tallies of one leaf joined by place: places, weights, smallest and largest value."""
    out = []
    for parts in lists:
        place, weight, low, high = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(place, kind="stable")
        place, weight, low, high = place[order], weight[order], low[order], high[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        out.append((place[first], np.add.reduceat(weight, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)))
    return out


# ---------------------------------------------------------------- fitting


def totals(blocks: DataFrame) -> tuple[float, float, float, int]:
    """Smallest and largest target, total weight, rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, weight, n = math.inf, -math.inf, 0.0, 0
        for batch in batches:
            for y, w in zip(batch.column("y").to_pylist(), batch.column("w").to_pylist()):
                y, w = np.frombuffer(y, np.float64), np.frombuffer(w, np.float64)
                low, high, weight, n = min(low, y.min()), max(high, y.max()), max(weight, w.max()), n + len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([high]), pa.array([weight]), pa.array([n])], names=["low", "high", "w", "n"])

    r = blocks.select("y", "w").mapInArrow(each, "low double, high double, w double, n long").agg(F.min("low"), F.max("high"), F.max("w"), F.sum("n")).first()
    return (r[0], r[1], r[2], r[3]) if r[3] else (0.0, 0.0, 0.0, 0)


def carried(blocks: DataFrame, now: Round) -> DataFrame:
    """The blocks with the recent trees added to their forecast."""
    features = len(now.forest.bins.features)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for i in range(batch.num_rows):
                b = Block(batch, i, features)
                new.append((b.f + now.forest.values(b.codes, b.unit, now.recent)).tobytes())
            at = batch.schema.get_field_index("f")
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, pa.binary()))

    return blocks.mapInArrow(each, BLOCK)


def fit(
    rows: DataFrame, features: Sequence[str], target: str, weight: str, key: Column, *, rounds: int, step: float = 0.1, leaves: int = 63, depth: int = 64, least: int = 20,
    bins: int = 64, loss: str = "absolute", share: float = 1.0, feature_share: float = 1.0, seed: int = 0, category: str | None = None, symmetric: bool = False, narrow: float = 1e-4,
) -> Forest:
    """Boosted trees on ``rows``, which are read twice: for the bins and to be binned. Pass a written table.

    ``key`` is a 64-bit hash of a row's keys; it alone decides which rows a round samples.
    """
    if loss not in LOSSES:
        raise ValueError(f"loss {loss!r} is none of {LOSSES}")
    n = rows.count()
    rows = rows.coalesce(max(1, math.ceil(n / TASK_ROWS)))
    known = learn_bins(rows, features, bins, key, n, category, target if symmetric else None)
    blocks = checkpointed(pack(rows, known, target, weight, key))
    return boost(
        blocks, known, rounds=rounds, step=step, leaves=leaves, depth=depth, least=least, loss=loss, share=share, feature_share=feature_share, seed=seed, symmetric=symmetric, narrow=narrow
    )


def boost(
    blocks: DataFrame, bins: Bins, *, rounds: int, step: float, leaves: int, depth: int, least: int, loss: str, share: float, feature_share: float, seed: int, symmetric: bool, narrow: float,
) -> Forest:
    low, high, heaviest, n = totals(blocks)
    parts = blocks.rdd.getNumPartitions()
    if not n:
        return Forest(bins, 0.0, step, ())
    spread = max(high - low, 1e-300)
    bound = n * heaviest * (max(1.0, 4 * spread) if loss == "squared" else 1.0)
    unit = 2.0 ** math.ceil(math.log2(bound) - EXACT_BITS)
    everything = Round(Forest(bins, 0.0, step, ()), (), loss, 1.0, seed, unit)
    root = Tree()
    if loss == "absolute":
        start = medians(blocks, parts, everything, root, (low, high), narrow).get(0, 0.0)
    else:
        start = mean_target(blocks, unit)
    trees: list = []
    held = 0  # trees already in the blocks
    draw = np.random.default_rng(seed)
    usable = [i for i, w in enumerate(bins.widths) if w or (i == bins.category and bins.codes)]
    reach = (low - start, high - start)
    for r in range(rounds):
        forest = Forest(bins, start, step, ())
        now = Round(forest, tuple(trees[held:]), loss, share, int(draw.integers(0, 2**63)), unit)
        some = max(1, round(feature_share * len(usable)))
        allowed = sorted(draw.choice(usable, some, replace=False).tolist()) if some < len(usable) else usable
        tree, sums = grow_symmetric(blocks, parts, now, allowed, depth, least) if symmetric else grow(blocks, parts, now, allowed, leaves, depth, least)
        if not sums:
            break  # no split helps
        if loss == "absolute":
            value = medians(blocks, parts, now, tree, reach, narrow)
        else:
            value = {leaf: -x[0] / x[1] for leaf, x in sums.items() if x[1]}
        if symmetric:
            tree = SymmetricTree(tree.feature, tree.code, tree.missing_left, tuple(value.get(i, 0.0) for i in range(1 << len(tree.feature))))
        else:
            tree.value = [value.get(i, 0.0) for i in range(len(tree.feature))]
        trees.append(tree)
        most, least_value = max(tree.value), min(tree.value)
        reach = (reach[0] - step * max(0.0, most), reach[1] - step * min(0.0, least_value))
        if len(trees) - held >= KEPT_ROUNDS and r + 1 < rounds:
            blocks = checkpointed(carried(blocks, Round(forest, tuple(trees[held:]), loss, share, 0, unit)))
            held = len(trees)
    return Forest(bins, start, step, tuple(trees))


def mean_target(blocks: DataFrame, unit: float) -> float:
    """The weighted mean, over whole multiples of the unit of exact sums."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = 0.0, 0.0
        for batch in batches:
            for y, w in zip(batch.column("y").to_pylist(), batch.column("w").to_pylist()):
                y, w = np.frombuffer(y, np.float64), np.frombuffer(w, np.float64)
                total, weight = total + np.rint(y * w / unit).sum(), weight + np.rint(w / unit).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([weight])], names=["t", "w"])

    r = blocks.select("y", "w").mapInArrow(each, "t double, w double").agg(F.sum("t"), F.sum("w")).first()
    return r[0] / r[1] if r[1] else 0.0


def staged_loss(blocks: DataFrame, forest: Forest, loss: str) -> list[float]:
    """The mean weighted loss after every round, in one pass over blocks whose forecast is zero."""
    features = len(forest.bins.features)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(len(forest.trees)), 0.0
        for b in blocks_of(batches, features):
            left = b.y - forest.start
            weight += b.w.sum()
            for i, tree in enumerate(forest.trees):
                left = left - forest.step * np.array(tree.value)[tree.leaves(b.codes, b.unit, forest.missing)]
                total[i] += (b.w * (np.abs(left) if loss == "absolute" else left * left)).sum()
        rounds = np.arange(len(forest.trees))
        yield pa.RecordBatch.from_arrays([pa.array(rounds), pa.array(total), pa.array(np.full(len(rounds), weight))], names=["r", "t", "w"])

    sums = blocks.mapInArrow(each, "r long, t double, w double").groupBy("r").agg(F.sum("t").alias("t"), F.sum("w").alias("w")).collect()
    return [r["t"] / r["w"] if r["w"] else 0.0 for r in sorted(sums, key=lambda r: r["r"])]
