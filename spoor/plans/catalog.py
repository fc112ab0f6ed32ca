"""All queries of the core: importing this module registers them."""

from __future__ import annotations

from spoor.plans import queries_names, queries_search, queries_text  # noqa: F401
from spoor.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
