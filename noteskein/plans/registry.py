"""Registered queries with their check in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noteskein.plans.views import VIEW_SQL, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str, extra: dict[str, str] | None = None, recursive: bool = False):
    """Register a query; ``views`` and ``extra`` become common table expressions of its SQL."""
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            text = with_views("", *views) if views else ""
            more = ", ".join(f"{n} AS ({s})" for n, s in (extra or {}).items())
            if more:
                text = f"{text.rstrip()}, {more} " if text else f"WITH {more} "
            ORACLES[name] = (text.replace("WITH", "WITH RECURSIVE", 1) if recursive else text) + sql
        return build

    return register


def known_views() -> list[str]:
    return sorted(VIEW_SQL)
