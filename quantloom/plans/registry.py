"""Query registry: a callable, the operator ids it covers and, where SQL can say it, an independent SQL statement."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quantloom.session import require_utc

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """Register a named subquery for oracle statements."""
    VIEWS[name] = sql


def _with_views(body: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in VIEWS:
            if word not in needed and re.search(rf"(?i)\b(from|join)\s+{word}\b", text):
                visit(VIEWS[word])
                if word not in needed:
                    needed.append(word)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} as materialized ({VIEWS[n]})" for n in needed)
    tail = body.strip()
    return f"with {ctes},\n{tail[5:]}" if tail[:5].lower() == "with " else f"with {ctes}\n{tail}"


def query(name: str, ids: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``name`` as covering the space-separated operator ``ids``."""

    def register(fn: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            require_utc(spark)
            return fn(spark, sf_dir)

        ENTRIES[name] = Entry(name, tuple(ids.split()), run, _with_views(sql) if sql else None)
        return fn

    return register


def r(expr: str, digits: int = 6) -> str:
    """SQL text rounding with negative zero removed."""
    return f"(round({expr},{digits})+0.0)"
