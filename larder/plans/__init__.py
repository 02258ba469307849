"""Whole runs, and the registered queries over the driver's tables."""

from __future__ import annotations

import importlib

MODULES = ("price_queries", "text_queries", "place_queries", "branch_queries", "page_queries")


def load_queries():
    """(queries, SQL) of every module that registers some."""
    for name in MODULES:
        importlib.import_module(f"larder.plans.{name}")
    from larder.plans.registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
