"""Registered queries, one module per area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("forecasting", "relational", "costing", "inference", "intervals", "learning")


def load():
    from partcast.catalog.registry import REGISTRY

    for area in AREAS:
        import_module(f"partcast.catalog.{area}")
    return REGISTRY
