"""Queries over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
MODULES = ("features", "windows_splits", "metrics", "transforms", "models", "formats", "more", "streams", "training")


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under ``name``."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"panelwright.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
