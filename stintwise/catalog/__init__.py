"""Named queries over the given tables."""

from __future__ import annotations

from importlib import import_module

from stintwise.catalog.registry import QUERIES, Query

_MODULES = ["lap_queries", "join_queries", "state_queries", "value_queries", "board_queries", "source_queries", "model_queries"]


def all_queries() -> dict[str, Query]:
    for module in _MODULES:
        import_module(f"stintwise.catalog.{module}")
    return QUERIES
