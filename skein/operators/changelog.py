"""Change logs of cells as tables: merge, inversion and replay.

A log has seq, item, col, oldv and newv; seq orders it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered

CELL = ("item", "col")


def with_old_values(log: DataFrame) -> DataFrame:
    """Derives oldv: what the cell had before."""
    return log.withColumn("oldv", F.lag("newv").over(Window.partitionBy(*CELL).orderBy("seq")))


def merged(log: DataFrame) -> DataFrame:
    """One update for each cell, in the place of its first: the first old and the last new value. Summed before the shuffle."""
    return log.groupBy(*CELL).agg(F.min("seq").alias("first_seq"), F.min_by("oldv", "seq").alias("first_old"), F.min_by("newv", "seq").alias("first_new"), F.max_by("newv", "seq").alias("last_new"))


def inverted(log: DataFrame) -> DataFrame:
    """The log that undoes it: reverse order, old and new exchanged. inv_seq numbers it from 1, by range partitions."""
    out = numbered(log, F.col("seq").desc(), name="inv_seq", start=1)
    return out.select("inv_seq", *CELL, F.col("newv").alias("inv_old"), F.col("oldv").alias("inv_new"))


def replayed(log: DataFrame) -> DataFrame:
    """The last value of each cell."""
    return log.groupBy(*CELL).agg(F.max_by("newv", "seq").alias("value"))


def applied(state: DataFrame, log: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """A table of cells (item, col, value) after a log, without removed items."""
    last = replayed(log).withColumnRenamed("value", "_new").withColumn("_set", F.lit(True))
    out = state.join(last, list(CELL), "full_outer").select(*CELL, F.when(F.col("_set"), F.col("_new")).otherwise(F.col("value")).alias("value"))
    return out if removed is None else out.join(removed.select("item").distinct(), "item", "left_anti")
