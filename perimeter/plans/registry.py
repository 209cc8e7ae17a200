"""Registry of runnable queries and of the SQL each is checked against.

Checks are written against named views; the views a statement mentions are found by name and put
in front of it as a WITH list."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from perimeter.plans.study import Study

QUERIES: dict[str, Callable[[Study], DataFrame]] = {}
CHECKS: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(fn: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
        if name in QUERIES:
            raise KeyError(f"query {name} registered twice")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn
    return register


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def _mentioned(sql: str) -> set[str]:
    return {w for w in re.findall(r"\bv_\w+", sql) if w in VIEWS}


def compose(sql: str) -> str:
    wanted: set[str] = set()
    todo = _mentioned(sql)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo |= _mentioned(VIEWS[name]) - {name}
    if not wanted:
        return sql
    parts = []
    for name, body in VIEWS.items():
        if name in wanted:
            recursive = name in _mentioned(body)
            parts.append(f"{name} AS ({body})" if recursive else f"{name} AS MATERIALIZED ({body})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Callable[[Study], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(Study(spark, folder))
    return {name: bind(fn) for name, fn in QUERIES.items()}


def checks() -> dict[str, str]:
    return {name: compose(sql) for name, sql in CHECKS.items()}
