"""All registered queries of the library outside `llm`."""

from __future__ import annotations

import importlib
import pkgutil

from tidemark import plans


def _modules():
    for info in pkgutil.iter_modules(plans.__path__):
        if info.name != "catalog":
            module = importlib.import_module(f"tidemark.plans.{info.name}")
            if hasattr(module, "QUERIES"):
                yield module


def queries() -> dict:
    return {name: query for m in _modules() for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
