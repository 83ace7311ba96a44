"""All queries of the engine's own operators."""

from __future__ import annotations

from wanetrack.plans import book, evaluation_queries, fleet_queries, history_queries, source_queries

__all__ = ["book", "evaluation_queries", "fleet_queries", "history_queries", "source_queries"]
