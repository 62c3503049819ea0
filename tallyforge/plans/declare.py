"""How a plan is registered with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Registers a plan under its function's name; ``sql`` may use the views of ``views.WITH``."""
    from tallyforge.plans.views import WITH

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            text = sql.strip()
            ORACLES[f.__name__] = (f"{WITH}, {text[5:]}" if text.startswith("WITH ") else f"{WITH} {text}") if views else text
        return f

    return add
