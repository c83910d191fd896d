"""The corpus queries and their SQL; __spark_entry__.py adds them if this package can be imported."""

from __future__ import annotations

import importlib
import pkgutil

from . import __path__ as _path

MODULES = [importlib.import_module(f"{__package__}.{m.name}") for m in pkgutil.iter_modules(_path) if m.name.startswith("query_")]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
