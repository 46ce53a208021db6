"""Registered queries over the driver tables and their comparison SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scalars", "serving", "prep", "features", "models", "streams")


def load():
    """(queries, comparison SQL) by name."""
    from flowsieve.catalog import base

    for name in MODULES:
        import_module(f"flowsieve.catalog.{name}")
    return base.QUERIES, base.ORACLES
