"""The register of queries over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Registers a function under its name, without a leading ``q_``."""
    QUERIES[f.__name__.removeprefix("q_")] = f
    return f
