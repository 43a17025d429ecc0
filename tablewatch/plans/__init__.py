"""Queries over the driver's tables, each next to its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, changes, review

_MODULES = [audit, changes, review]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in _MODULES for k, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _MODULES for k, (_, sql) in m.QUERIES.items() if sql}
