"""Queries over the driver tables."""

from __future__ import annotations

from importlib import import_module

from minekit.plans.registry import QUERIES, Query

CATALOGS = ["core", "cleaning", "learning", "timeseries", "inout"]


def all_queries() -> dict[str, Query]:
    for name in CATALOGS:
        import_module(f"minekit.plans.{name}")
    return QUERIES
