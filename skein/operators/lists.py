"""List positions as arithmetic on columns, and ordered replay of list operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError


def rotated(index: Column, start: int, count: int, offset: int) -> Column:
    """The position after rotating ``count`` elements from ``start``; a positive offset moves them towards the front."""
    return F.when((index >= start) & (index < start + count), start + F.pmod(index - start - offset, F.lit(count))).otherwise(index) if count else index


def after_insert(index: Column, at: int) -> Column:
    """Positions of the others once an element is put in at ``at``."""
    return F.when(index >= at, index + 1).otherwise(index)


def after_remove(index: Column, at: int) -> Column:
    return F.when(index > at, index - 1).otherwise(index)


def reindexed(df: DataFrame, group: str, by: list[str], name: str = "list_index") -> DataFrame:
    """Contiguous positions from 0 in each group; rows without a group are unattached and have none."""
    w = Window.partitionBy(group).orderBy(*by)
    return df.withColumn(name, F.when(F.col(group).isNotNull(), (F.row_number().over(w) - 1).cast("bigint")))


def rotate(df: DataFrame, group: str, index: str, start: int, count: int, offset: int, name: str | None = None) -> DataFrame:
    """Rotates a range in every group that has it whole."""
    if start < 0 or count < 0:
        raise QueryError("a range has no negative start or count")
    size = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= start + count).select(F.col(group).alias("_g"))
    return df.join(size, F.col(group) == F.col("_g"), "left_semi").withColumn(name or index, rotated(F.col(index), start, count, offset).cast("bigint"))


def order_violations(df: DataFrame, group: str, index: str) -> DataFrame:
    """Groups whose positions aren't 0, 1, 2, …"""
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("lo"), F.max(index).alias("hi"), F.count_distinct(index).alias("d"))
    return g.where((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("d") != F.col("n")))


def apply_list_op(order: list, op: str, item=None, at: int = 0, count: int = 0, offset: int = 0) -> None:
    """One operation on a group's sequence, in place."""
    if op == "insert":
        order.insert(at, item)
    elif op == "remove":
        if at is not None and 0 <= at < len(order) and (item is None or order[at] == item):
            del order[at]
        else:
            order.remove(item)
    elif op == "rotate":
        part = order[at : at + count]
        k = offset % count if count else 0
        order[at : at + count] = part[k:] + part[:k]
    else:
        raise QueryError(f"no list operation {op}")


def replay(state: DataFrame, log: DataFrame) -> DataFrame:
    """Sequences after a log of list operations: grp, item, list_index.

    ``state`` has grp, item, list_index; ``log`` has seq, grp, op (insert, remove,
    rotate), item, at, cnt, off. A move between groups is a remove and an insert with
    the same seq. Operations of a group depend on each other and are folded in
    order by the task that holds the group; groups are independent.
    """
    import pandas as pd

    def fold(key, rows, ops):
        order = rows.sort_values("list_index")["item"].tolist()
        for r in ops.sort_values("seq").itertuples():
            apply_list_op(order, r.op, None if pd.isna(r.item) else int(r.item), 0 if pd.isna(r.at) else int(r.at), 0 if pd.isna(r.cnt) else int(r.cnt), 0 if pd.isna(r.off) else int(r.off))
        return pd.DataFrame({"grp": key[0], "item": pd.Series(order, dtype="int64"), "list_index": pd.Series(range(len(order)), dtype="int64")})

    return state.groupBy("grp").cogroup(log.groupBy("grp")).applyInPandas(fold, "grp bigint, item bigint, list_index bigint")
