"""Small deterministic panels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelloom.spec import PanelSpec

HOURLY = PanelSpec(
    signals=("sig_a", "sig_b", "exact"), nullable=("sig_a", "sig_b"), statics=("capacity",), season=24, score_len=24,
    train_end=96, late_from=16, lags=(1, 2, 24), rolls=(4, 24), series_len=168,
)


def identity_panel(spark, n_series: int = 2, n: int = 60):
    """y[t] = t + 1000 * series, so any lag can be read from its value."""
    return spark.range(n_series * n).select(
        F.concat(F.lit("u"), F.floor(F.col("id") / n).cast("string")).alias("unique_id"),
        F.timestamp_seconds(F.lit(1_672_617_600) + F.pmod("id", F.lit(n)) * 3600).alias("ds"),
        F.pmod("id", F.lit(n)).alias("hidx"),
        (F.pmod("id", F.lit(n)) + 1000 * F.floor(F.col("id") / n)).cast("double").alias("y"),
        F.pmod("id", F.lit(n)).cast("double").alias("x"),
        F.floor(F.col("id") / n).cast("double").alias("capacity"),
    )


def random_panel(n_series: int = 4, n: int = 21 * 24, seed: int = 0, holes: float = 0.05) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = []
    ds = pd.date_range("2023-01-02", periods=n, freq="h")
    how = ds.dayofweek * 24 + ds.hour
    for s in range(n_series):
        a = 10 + s + 3 * np.sin(2 * np.pi * how / 168) + rng.normal(0, 0.3, n)
        b = rng.normal(0, 1, n)
        hole = rng.random(n) < holes
        rows.append(
            pd.DataFrame(
                {
                    "unique_id": f"u{s}", "ds": ds, "hidx": np.arange(n), "y": np.abs(a + rng.normal(0, 1, n)),
                    "sig_a": np.where(hole, np.nan, a), "sig_b": np.where(rng.random(n) < holes, np.nan, b),
                    "exact": s + 0.5 * how, "capacity": 1.0 + s, "zone": s % 2,
                }
            )
        )
    return pd.concat(rows, ignore_index=True)


def to_spark(spark, pdf: pd.DataFrame):
    """Missing values become NULL, not NaN."""
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema=_schema(pdf))


def _schema(pdf: pd.DataFrame) -> str:
    kinds = {"i": "long", "f": "double", "M": "timestamp", "b": "boolean"}
    return ", ".join(f"{c} {kinds.get(t.kind, 'string')}" for c, t in pdf.dtypes.items())


def pull(df, *order: str) -> pd.DataFrame:
    return df.orderBy(*order).toPandas().reset_index(drop=True)
