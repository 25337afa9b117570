"""Whole jobs composed from the operators, and the adapters that feed them from given tables."""

from flowsight.plans import (  # noqa: F401
    file_queries,
    model_queries,
    policy_queries,
    quality_queries,
    source_queries,
    streaming_queries,
    traffic_queries,
    training_queries,
)
from flowsight.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
