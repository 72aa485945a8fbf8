"""Putting member forecasts and labels together on identical rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.session import checkpointed
from panelloom.spec import PanelSpec


def join_members(frames: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """One column per member on the keys all members share, one row each.

    Members are stacked and regrouped, so any number of them costs one shuffle. A key one member
    lacks or holds twice raises instead of shrinking the cube.
    """
    keys = list(keys)
    names = list(frames)
    long = None
    for m, f in frames.items():
        part = f.select(*keys, F.lit(m).alias("_m"), F.col(m).alias("_p"))
        long = part if long is None else long.unionByName(part)
    wide = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *(F.max(F.when(F.col("_m") == m, F.col("_p"))).alias(m) for m in names),
        *(F.sum((F.col("_m") == m).cast("int")).alias(f"_n_{m}") for m in names),
    )
    wide = checkpointed(wide)  # read by the check and by the result
    uneven = F.lit(False)
    for m in names:
        uneven = uneven | (F.col(f"_n_{m}") != 1)
    bad = wide.filter(uneven).count()
    if bad:
        raise ValueError(f"{bad} keys are not held exactly once by every member of {names}")
    return wide.select(*keys, *names)


def with_labels(preds: DataFrame, df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Labels by key; a forecast row without a label raises."""
    labels = df.select(spec.id, spec.time, spec.target)
    out = checkpointed(preds.join(labels, [spec.id, spec.time], "left"))  # read by the check and by the result
    gaps = out.filter(F.col(spec.target).isNull()).count()
    if gaps:
        raise ValueError(f"{gaps} forecast rows have no label")
    return out


def shared_windows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` in windows that ``b`` also has."""
    return a.join(b.select("cutoff").distinct(), "cutoff", "left_semi")
