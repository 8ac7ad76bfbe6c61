"""Imports every query module, so that the registry is complete."""

from __future__ import annotations

from flowloom.plans import (  # noqa: F401
    feature_queries,
    graph_queries,
    model_queries,
    source_queries,
    storage_queries,
    view_queries,
)
from flowloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
