"""All registered queries."""

from panelloom.plans.catalog import (  # noqa: F401
    aggregate_queries,
    block_queries,
    evaluate_queries,
    forecast_queries,
    impute_queries,
    row_queries,
    source_queries,
)
from panelloom.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
