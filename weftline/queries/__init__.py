"""The registered queries of the core and the SQL that gives the same rows."""

from __future__ import annotations

import importlib

from .tables import Query

_FAMILIES = ("trees", "store", "texts", "vocab", "registries", "ranks", "sparqls", "streams", "knowledge", "alignments", "relations", "roundtrips")


def _modules():
    return [importlib.import_module(f"{__name__}.{name}") for name in _FAMILIES]


def queries() -> dict[str, Query]:
    return {name: f for module in _modules() for name, f in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for give in (module.oracle_sql, getattr(module, "more_sql", dict)) for name, sql in give().items()}
