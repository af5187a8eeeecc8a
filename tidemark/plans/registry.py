"""Where plan modules register a query and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import duck_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = duck_sql(oracle)
        return fn

    return add


def us(col: Column | str) -> Column:
    """Microseconds since 1970, which both engines print alike."""
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))
