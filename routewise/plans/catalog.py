"""Registered queries: one Spark callable and (where SQL can express it) one
DuckDB oracle per operator id of the inventory.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
driver tables (or tables Spark derives from them).  Computed doubles are
rounded to 6 places on both sides so the order-insensitive hash compares
values, not the last bit of a logarithm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from . import q_features, q_responses, q_scores, q_labels, q_routing, q_sources, q_textmetrics  # noqa: F401
    from . import q_models, q_leaderboard, q_misc  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
