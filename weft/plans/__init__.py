"""Registered queries of the library and their SQL."""

from __future__ import annotations

import importlib

from . import registry

MODULES = ["similarity", "relations", "texts", "knowledge", "records", "lookups", "streams", "matching", "rules", "runs", "small", "searches"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
