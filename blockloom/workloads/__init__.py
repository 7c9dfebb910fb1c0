"""Benchmark views and registered queries."""

from __future__ import annotations

from importlib import import_module

from blockloom.workloads.registry import ORACLES, QUERIES, Query

MODULES = ("scalars", "scans", "relational", "planning", "tables", "rules", "live")


def all_queries() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"blockloom.workloads.{name}")
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    all_queries()
    return dict(ORACLES)
