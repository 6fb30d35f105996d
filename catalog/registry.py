"""Query and oracle registration."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is the body of the DuckDB SQL, fixture CTEs are put in front of it."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_fixtures(oracle)
        return fn

    return register


def with_fixtures(body: str) -> str:
    """Prefix the CTEs of every ``fx_`` name used in ``body``, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+", text)):
            if name not in order:
                visit(fixtures.duck_sql(name))
                order.append(name)

    visit(body)
    ctes = [f"{name} as ({fixtures.duck_sql(name).strip()})" for name in order]
    body = body.strip()
    head = re.match(r"with\s+(recursive\s+)?", body, re.IGNORECASE)
    if head:
        if not ctes:
            return body
        return "with recursive " + ",\n".join(ctes) + ",\n" + body[head.end():]
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body
