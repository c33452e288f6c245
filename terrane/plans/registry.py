"""Names the queries of the package and their DuckDB counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
MODULES = ("scans", "projections", "pixels", "joins", "series", "evaluation", "models", "files")


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with SQL of the same rows where there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"terrane.plans.{m}")


def queries() -> dict[str, Callable]:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(SQL)
