"""Registered queries: operators applied to the test tables, with the equivalent SQL."""

from __future__ import annotations

import importlib

from .registry import QUERIES, SQL, Query

MODULES = ("transforms", "profiles", "discovery", "conformance", "quality", "views", "rules", "extras", "fragments", "comparisons", "repairs")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
