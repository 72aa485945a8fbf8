"""Statistics across series at one position, without gathering a timestamp's series into one task.

Every statistic is a partially aggregated ``groupBy`` on the position, joined back. One row per
position is at most ``spec.chunk_rows`` rows when the calendar is known to be that short: then the
table is sent to every task and the panel itself is not shuffled. Without that bound, or with one row
per position and zone, the join is left to the measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.spec import PanelSpec


def system(df: DataFrame, spec: PanelSpec, aggs: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """One row per position (and ``by``)."""
    return df.groupBy(spec.index, *by).agg(*(x.alias(n) for n, x in aggs.items()))


def attach(df: DataFrame, table: DataFrame, spec: PanelSpec, by: Sequence[str] = ()) -> DataFrame:
    if spec.bounded and not by:
        table = F.broadcast(table)
    return df.join(table, [spec.index, *by], "left")


def spread_back(df: DataFrame, spec: PanelSpec, aggs: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    return attach(df, system(df, spec, aggs, by), spec, by)
