"""Registered queries with their DuckDB SQL."""

from __future__ import annotations

import importlib

MODULES = ("features", "detectors", "evaluation", "fusion", "backtests", "geometry", "models", "streams", "studies", "inference", "tables")


def load():
    """(queries, oracles) of every plan module."""
    from . import registry

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.ORACLES
