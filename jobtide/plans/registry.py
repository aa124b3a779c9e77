"""The registered queries and, where SQL can say the same, their oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def load_all() -> None:
    from jobtide.plans import (  # noqa: F401
        q_arrivals,
        q_episodes,
        q_features,
        q_ingest,
        q_monitor,
        q_occupancy,
        q_placement,
        q_settings,
        q_stats,
        q_streams,
        q_tables,
    )
