"""Aggregates kept by parent: partial rows that can be merged, added to and read instead of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(df: DataFrame, parent: str, value: str) -> DataFrame:
    """n, total, lo, hi and nulls of a value by parent."""
    return df.groupBy(F.col(parent).alias("parent")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_if(F.col(value).isNull()).alias("nulls"))


def merge_rollups(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("parent").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("nulls").alias("nulls"))


def read_rollup(r: DataFrame, kind: str, parents: list | None = None, by_parent: bool = True) -> DataFrame:
    """What aggregating the rows would give: count, sum, min (null if any value is) or max."""
    if parents is not None:
        keys = list(dict.fromkeys(p for p in parents if p is not None))
        r = r.where(F.coalesce(F.col("parent").isin(keys), F.lit(False)) | (F.col("parent").isNull() & F.lit(None in parents)))
    made = {
        "count": F.coalesce(F.sum("n"), F.lit(0)),
        "sum": F.sum("total"),
        "min": F.when(F.sum("nulls") > 0, None).otherwise(F.min("lo")),
        "max": F.max("hi"),
    }[kind].alias("value")
    return r.groupBy(F.col("parent").alias("group_key")).agg(made) if by_parent else r.agg(made)
