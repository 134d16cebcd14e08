"""Queries and their independent SQL checks, registered side by side."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    """Name a reusable SQL block; ``build`` pulls in the blocks a text mentions."""
    if name in CTES and CTES[name] != sql:
        raise ValueError(f"block {name} defined twice")
    CTES[name] = sql


def build(sql: str) -> str:
    order: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\b[a-z][a-z0-9_]*\b", text):
            if word in CTES and word not in order:
                visit(CTES[word])
                if word not in order:
                    order.append(word)

    visit(sql)
    if not order:
        return sql
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH RECURSIVE {parts},\n{sql.lstrip()[5:]}"
    return f"WITH RECURSIVE {parts}\n{sql}"


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register
