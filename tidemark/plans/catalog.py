"""All engine queries with the SQL that checks them."""

from __future__ import annotations

from tidemark.plans import derived_queries, identity_queries, loader_queries, mapper_queries, market_queries, promotion_queries, provider_queries, quality_queries, request_queries, scalar_queries, source_queries, strategy_queries, temporal_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
