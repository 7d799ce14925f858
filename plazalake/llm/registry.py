"""The queries of the numbered operators, and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from plazalake import llm


def _modules():
    for found in sorted(pkgutil.iter_modules(llm.__path__), key=lambda m: m.name):
        if found.name.startswith("q_"):
            yield importlib.import_module(f"{llm.__name__}.{found.name}")


def queries() -> dict:
    return {name: fn for module in _modules() for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
