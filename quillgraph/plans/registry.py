"""Named queries over the graph model, with their DuckDB equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("relational", "vectors", "matching", "state", "graphs", "texts", "exports", "chatting", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


_VIEWS = {"entities": T.ENTITIES_SQL, "statements": T.STATEMENTS_SQL, "nodes": T.NODES_SQL, "edges": T.EDGES_SQL}


def with_views(*names: str, also: str = "") -> str:
    """WITH clause of the graph model's views in DuckDB; `also` holds further ones."""
    return "WITH " + ",".join([_VIEWS[n] for n in names] + ([also] if also else [])) + "\n"


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"quillgraph.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
