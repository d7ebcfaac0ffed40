"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.sql_views import SQL_VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix a statement with the views it mentions, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if name in SQL_VIEWS and name not in needed:
                visit(SQL_VIEWS[name].replace(name, ""))
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in needed)
    recursive = "RECURSIVE " if sql.lstrip().upper().startswith("WITH RECURSIVE") else ""
    body = re.sub(r"\A\s*WITH\s+(RECURSIVE\s+)?", ", ", sql, flags=re.I) if re.match(r"\s*WITH\b", sql, re.I) else "\n" + sql
    return f"WITH {recursive}{views}{body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return register
