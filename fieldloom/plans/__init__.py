"""Operators composed into queries on the shared tables."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "encode",
    "core_queries",
    "time_queries",
    "entropy_queries",
    "spatial_queries",
    "scoring_queries",
    "source_queries",
    "stream_queries",
    "gap_queries",
    "kernel_queries",
)


def load_queries():
    """All registered queries and their SQL twins."""
    from . import registry

    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.ORACLES
