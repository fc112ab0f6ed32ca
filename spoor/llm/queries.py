"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("vectors", "spans", "pairs", "terms", "conversations", "packing", "mixing", "reading", "pii", "truncation")


def _all(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"spoor.llm.{name}"), what)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
