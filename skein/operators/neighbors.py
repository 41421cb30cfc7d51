"""Neighbours in an ordered group: previous and next, of stored rows and of probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(group_by: list[str], order_by: list[str], id_col: str):
    return Window.partitionBy(*group_by).orderBy(*order_by, id_col)


def _indexed(group_by: list[str], order_by: list[str]) -> Column:
    """Rows with a null in a key are in no group."""
    keys = [F.col(c).isNotNull() for c in (*group_by, *order_by)]
    out = keys[0]
    for k in keys[1:]:
        out = out & k
    return out


def neighbours(df: DataFrame, group_by: list[str], order_by: list[str], id_col: str = "item_id", prev: str = "prev_id", next: str = "next_id") -> DataFrame:
    """``df``'s indexed rows with the ids of their neighbours: one shuffle on the group."""
    w = _window(group_by, order_by, id_col)
    rows = df.where(_indexed(group_by, order_by))
    return rows.withColumn(prev, F.lag(id_col).over(w)).withColumn(next, F.lead(id_col).over(w))


def first_of_each(df: DataFrame, group_by: list[str], order_by: list[str], k: int, id_col: str = "item_id") -> DataFrame:
    """The first k rows of each group; the planner limits groups before the shuffle."""
    w = _window(group_by, order_by, id_col)
    return df.where(_indexed(group_by, order_by)).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def as_of(probes: DataFrame, rows: DataFrame, group_by: list[str], order_by: list[str], id_col: str = "item_id", forward: bool = False, name: str = "neighbour_id") -> DataFrame:
    """Each probe with the id of the nearest row strictly before it (after it if ``forward``) by (order_by, id).

    Both sides have group, order and id columns. They are put in one sequence, a
    probe before the row that it equals, and the last row's id is carried along: a
    union and a window, without a range join.
    """
    keys = [*group_by, *order_by, id_col]
    both = rows.where(_indexed(group_by, order_by)).select(*keys, F.lit(True).alias("_row"), F.lit(None).cast("struct<x:int>").alias("_x"))
    asked = probes.select(*keys, F.lit(False).alias("_row"), F.lit(None).cast("struct<x:int>").alias("_x"))
    order = [F.col(c).desc() if forward else F.col(c).asc() for c in (*order_by, id_col)]
    w = Window.partitionBy(*group_by).orderBy(*order, F.col("_row").asc()).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.union(asked).withColumn(name, F.last(F.when(F.col("_row"), F.col(id_col)), ignorenulls=True).over(w))
    return seen.where(~F.col("_row")).drop("_row", "_x")
