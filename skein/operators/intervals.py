"""Overlap of half-open intervals [start, end) within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlapping(df: DataFrame, start: str, end: str, probe_start, probe_end, group: dict[str, object] | None = None, id_col: str = "item_id", excluded: list[int] = ()) -> DataFrame:
    """Rows that overlap a probe, of the probe's group. Null or empty intervals, of rows or probe, overlap nothing."""
    if probe_start is None or probe_end is None or probe_start >= probe_end:
        return df.where(F.lit(False))
    where = (F.col(start) < F.col(end)) & (F.col(start) < F.lit(probe_end)) & (F.col(end) > F.lit(probe_start))
    for name, value in (group or {}).items():
        where = where & (F.col(name) == F.lit(value))
    return df.where(where & ~F.col(id_col).isin(list(excluded))) if excluded else df.where(where)


def overlap_pairs(df: DataFrame, start: str, end: str, group_by: list[str], id_col: str = "item_id", width: int | None = None) -> DataFrame:
    """a_id < b_id of all overlapping rows of a group.

    With ``width`` rows are put in bins of that width by ``floor(start / width)`` up to
    their end, and a pair is made only in the bin where the later of both begins, so
    that a large group is spread over its bins; choose it near the usual length.
    """
    ok = (F.col(start) < F.col(end)) & F.col(start).isNotNull() & F.col(end).isNotNull()
    rows = df.where(ok).select(*group_by, F.col(id_col).alias("_i"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    if width:
        last = F.ceil(F.col("_e") / width) - 1
        rows = rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / width), last)))
        group_by = [*group_by, "_bin"]
    a = rows.select(*group_by, F.col("_i").alias("a_id"), F.col("_s").alias("a_s"), F.col("_e").alias("a_e"))
    b = rows.select(*group_by, F.col("_i").alias("b_id"), F.col("_s").alias("b_s"), F.col("_e").alias("b_e"))
    met = a.join(b, group_by).where((F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e")) & (F.col("a_id") < F.col("b_id")))
    if width:
        met = met.where(F.col("_bin") == F.floor(F.greatest("a_s", "b_s") / width))
    return met.select("a_id", "b_id")


def whole_interval(start: Column, length: int) -> tuple[Column, Column]:
    """An interval of integers of a length from the floor of a number."""
    s = F.floor(start).cast("bigint")
    return s, s + length
