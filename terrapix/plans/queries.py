"""All queries of the library and their oracles."""

from __future__ import annotations

from . import q_aggregates, q_joins, q_ordered, q_scalar, q_stats  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
