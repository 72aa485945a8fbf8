"""Leading singular vectors of a matrix given as cells, without a square matrix over either side.

A block of vectors over the rows is multiplied by the matrix and its transpose: two partial aggregations of the cells. The
results extend an orthonormal basis, on which the problem is as small as the basis and is solved on the driver. That is
repeated until the wanted vectors solve their equation, or the basis has nothing to add and is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.session import checkpointed

#: Singular values (squared) below this share of the largest count as none.
EMPTY = 1e-10


def _gram(table: DataFrame, columns: tuple[str, ...]) -> np.ndarray:
    """All scalar products of the entries of array columns over the rows, summed in the tasks first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.concatenate([_matrix(batch.column(c)) for c in columns], axis=1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    got = table.select(*columns).mapInArrow(each, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    n = 1 + max(got.column("i").to_pylist(), default=-1)
    out = np.zeros((n, n))
    out[got.column("i").to_numpy(), got.column("j").to_numpy()] = got.column("v").to_numpy()
    return (out + out.T) / 2


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _times(table: DataFrame, columns: tuple[str, ...], by: np.ndarray, out: str) -> DataFrame:
    """``table`` with ``out``: the entries of the array columns, one after the other, times a matrix."""

    @F.pandas_udf("array<double>")
    def apply(*parts):
        import pandas as pd

        x = np.concatenate([np.stack([np.asarray(v, np.float64) for v in p]) if len(p) else np.empty((0, by.shape[0])) for p in parts], axis=1)
        return pd.Series(list(x @ by))

    return table.withColumn(out, apply(*(F.col(c) for c in columns)))


def _spread(cells: DataFrame, row: str, column: str, value: str, block: DataFrame, width: int) -> DataFrame:
    """``row``, ``w``: the matrix times its transpose applied to the ``width`` vectors ``q`` of ``block``."""

    def sums(side: DataFrame, own: str, other: str, name: str) -> DataFrame:
        joined = cells.join(side, own)
        return joined.groupBy(other).agg(F.array(*(F.sum(F.col(value) * F.col(name)[j]) for j in range(width))).alias(f"{name}_"))

    across = sums(block, row, column, "q").withColumnRenamed("q_", "s")
    return sums(across, column, row, "s").withColumnRenamed("s_", "w")


def leading_vectors(cells: DataFrame, row: str, column: str, value: str, k: int, extra: int = 13, tolerance: float = 1e-10, most: int = 60) -> DataFrame:
    """``row``, ``u``: the ``k`` leading left singular vectors of the matrix, an array per row, the largest singular value first.

    ``cells`` has a value (never NULL) per row and column; what is absent is zero. Fewer vectors come back where the matrix has a lower rank.
    """
    cells = checkpointed(cells.select(row, column, value))
    width = k + extra
    drawn = F.array(*(F.xxhash64(F.col(row), F.lit(j)) / F.lit(2.0**63) for j in range(width)))
    basis = cells.select(row).distinct().withColumn("q", drawn)
    gram = _gram(basis, ("q",))
    if not len(gram):
        return basis.select(row, F.array().cast("array<double>").alias("u"))
    basis = checkpointed(_times(basis, ("q",), _inverse_root(gram), "q"))
    block, applied = basis, False
    for _ in range(most):
        size = int(block.select(F.size("q")).first()[0])
        spread = _spread(cells, row, column, value, block, size)
        table = basis.join(spread, row, "left")
        empty = F.array(*[F.lit(0.0)] * size)
        table = table.withColumn("w", F.coalesce("w", empty))
        table = checkpointed(table.withColumn("aq", F.concat("aq", "w") if applied else F.col("w")))
        applied = True
        m = int(table.select(F.size("q")).first()[0])
        gram = _gram(table, ("q", "aq"))
        small = (gram[:m, m:] + gram[:m, m:].T) / 2
        values, vectors = np.linalg.eigh(small)
        order = np.argsort(-values)[:k]
        values, vectors = values[order], vectors[:, order]
        last = max(values.max(initial=0.0), 1e-300)
        left = np.concatenate([-vectors * values, vectors])  # what the equation leaves over, from q and from its image
        rough = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", left, gram, left), 0.0))
        lengths = rough
        if rough.max(initial=0.0) <= 1e-5 * last:  # where products no longer tell, the vectors themselves do
            over = _times(table, ("q", "aq"), left, "over").select(F.array(*(F.col("over")[j] * F.col("over")[j] for j in range(len(order)))).alias("o"))
            lengths = np.sqrt([r or 0.0 for r in over.agg(*(F.sum(F.col("o")[j]) for j in range(len(order)))).first()])
        # the new block: the images of the last one without what the basis has, twice for accuracy
        fresh = None
        if lengths.max(initial=0.0) > tolerance * last:
            inside = gram[:m, 2 * m - size :]
            keep = _inverse_root(gram[2 * m - size :, 2 * m - size :] - inside.T @ inside, floor=(1e-7 * last) ** 2)
            if keep.shape[1]:
                once = _times(table, ("q", "w"), np.concatenate([-inside, np.eye(size)]) @ keep, "n")
                again = _gram(once, ("q", "n"))
                inside = again[:m, m:]
                keep = _inverse_root(again[m:, m:] - inside.T @ inside)
                fresh = checkpointed(_times(once, ("q", "n"), np.concatenate([-inside, np.eye(inside.shape[1])]) @ keep, "n"))
        if fresh is None:
            found = values > EMPTY * last
            return _times(table, ("q",), vectors[:, found], "u").select(row, "u")
        basis = fresh.select(row, F.concat("q", "n").alias("q"), "aq")
        block = fresh.select(row, F.col("n").alias("q"))
    raise RuntimeError(f"the leading vectors did not settle in {most} steps")


def _inverse_root(gram: np.ndarray, floor: float = 0.0) -> np.ndarray:
    """The matrix that makes vectors with these scalar products orthonormal; directions with next to no length are left out."""
    values, vectors = np.linalg.eigh(gram)
    use = values > max(floor, 1e-14 * max(values.max(initial=0.0), 1e-300))
    return vectors[:, use] / np.sqrt(values[use])
