"""Row numbers over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import persisted

_ROWS = 33  # bits of a row's place in its partition, as Spark lays them out


def numbered(df: DataFrame, *order: Column, name: str = "pos", start: int = 0) -> DataFrame:
    """``df`` with places from ``start`` in an order that has no ties.

    Rows go to range partitions and are sorted there; a partition's first place is the
    sum of the sizes before it, of which there is one row each.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = persisted(placed).withColumn("_p", F.shiftright("_m", _ROWS)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << _ROWS) - 1)))
    sizes = placed.groupBy("_p").agg((F.max("_i") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_before"))
    return placed.join(offsets, "_p").withColumn(name, (F.col("_before") + F.col("_i") + start).cast("bigint")).drop("_p", "_i", "_m", "_before")
