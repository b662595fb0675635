"""Registered queries over the driver tables, with their reference SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules that register queries when imported.
MODULES = ("matching", "extraction", "normalization", "sequences", "scoring", "curation", "policies", "state", "findings", "decisions", "landings")


def load():
    """(queries, reference SQL) of all modules."""
    from . import registry

    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.SQL
