"""Registry of the library's queries and of their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Inputs, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None) -> Callable:
    """Register a function of :class:`Inputs`; ``sql`` reads the given views and is the oracle."""

    def add(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql is not None:
            head = with_views(*views.split()) if views else ""
            body = sql.strip()
            if head and body.upper().startswith("WITH "):
                body = "," + body[5:]
            ORACLES[name] = f"{head} {body}"
        return f

    return add
