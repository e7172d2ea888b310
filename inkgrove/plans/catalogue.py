"""All registered queries and their SQL."""

from __future__ import annotations

from inkgrove.plans import audit_queries, index_queries, more_queries, policy_queries, retrieval_queries, text_queries, upkeep_queries  # noqa: F401
from inkgrove.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
