"""All registered queries."""

from noteskein.plans import (  # noqa: F401
    classify_queries, graph_queries, note_queries, quality_queries, store_queries, upkeep_queries,
)
from noteskein.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
