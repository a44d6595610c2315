"""All registered queries of the library proper, with their SQL twins."""

from __future__ import annotations

from catalith.plans import concept_queries, edit_queries, query_queries, store_queries  # noqa: F401  (they register themselves)
from catalith.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
