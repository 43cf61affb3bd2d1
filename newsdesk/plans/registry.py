"""The registered queries and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsdesk.plans.frames import frame, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, frames: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, *frames), with DuckDB SQL over the same frames."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(spark, *(frame(spark, sf_dir, n) for n in frames.split()))
        if sql is not None:
            ORACLES[name] = oracle(frames, sql)
        return f

    return add
