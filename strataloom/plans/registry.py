"""All queries of the core and their independent SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

NAMES = ["incremental_queries", "text_queries", "sequence_queries", "graph_queries", "relation_queries", "vector_queries", "store_queries", "code_queries", "rule_queries", "stream_queries"]


def registrar() -> tuple[dict, dict[str, str], Callable]:
    """(queries, sql, decorator) of a module: ``@query(sql)`` registers a function under its name."""
    queries: dict = {}
    statements: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                statements[f.__name__] = sql
            return f

        return add

    return queries, statements, query


def modules() -> list:
    return [importlib.import_module(f"strataloom.plans.{n}") for n in NAMES]


def queries() -> dict:
    return {name: f for m in modules() for name, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: s for m in modules() for name, s in m.SQL.items()}
