"""Registration of checked queries: a Spark plan, and the SQL an independent engine runs beside it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.plans.tables import Tables, with_ctes


def shift(digits: int) -> float:
    """Moves short fractions off the rounding tie, where engines differ; adding zero drops a negative zero."""
    return float(f"1.7e-{digits + 2}")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    digits: Mapping[str, int]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        named = {c.strip('"'): n for c, n in self.digits.items()}
        return df.withColumns({c: F.round(F.col(c) + F.lit(shift(n)), n) + F.lit(0.0) for c, n in named.items()})

    @property
    def oracle(self) -> str | None:
        if self.sql is None or not self.digits:
            return self.sql
        cols = ", ".join(f"round({c} + {shift(n):e}, {n}) + 0e0 AS {c}" for c, n in self.digits.items())
        return f"SELECT * REPLACE ({cols}) FROM (\n{self.sql}\n)"


REGISTRY: dict[str, Query] = {}


def query(name: str, using: str = "", sql: str | None = None, digits: Sequence[str] | Mapping[str, int] = ()):
    """Register a plan builder; ``digits`` names the floating columns compared to six decimals."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        places = dict(digits) if isinstance(digits, Mapping) else {c: 6 for c in (digits.split() if isinstance(digits, str) else digits)}
        REGISTRY[name] = Query(name, build, with_ctes(using, sql) if sql else None, places)
        return build

    return add
