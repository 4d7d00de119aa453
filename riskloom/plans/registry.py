"""Query registry: each registered query is ``(spark, sf_dir) -> DataFrame`` plus,
when the result is SQL-expressible, the equivalent DuckDB SQL over the fixture
tables (the correctness oracle)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco
