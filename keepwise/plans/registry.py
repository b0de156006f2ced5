"""Query registry: key -> (Spark builder, DuckDB oracle text or None)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register a query; ``oracle`` is DuckDB SQL over the driver tables."""
    def deco(fn: QueryFn) -> QueryFn:
        _QUERIES[key] = fn
        if oracle is not None:
            _ORACLES[key] = oracle
        return fn

    return deco


def _load() -> None:
    # importing the modules registers their queries
    from keepwise.plans import (  # noqa: F401
        q_clean, q_describe, q_events, q_metrics, q_models, q_scored, q_sources,
    )


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(sorted(_QUERIES.items(), key=lambda kv: _sort_key(kv[0])))


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _sort_key(k: str):
    head = k.split("_", 1)[0]
    return (head[0], int(head[1:]) if head[1:].isdigit() else 0, k)
