"""All registered queries."""

from __future__ import annotations

from plantweave.plans import (  # noqa: F401
    asset_queries,
    document_queries,
    drift_queries,
    mapping_queries,
    message_queries,
    publish_queries,
    semantic_queries,
)
from plantweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
