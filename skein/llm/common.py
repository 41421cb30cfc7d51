"""Shared plumbing of the text operators.

Every operator takes a DataFrame that has at least the columns it names and ignores
all other columns unless it says that it carries them along. Of the session's
configuration only the size of record batches between Spark and Python is lowered, and
by ``repeats`` shuffle files are dropped early while its steps run.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import discard, persisted, shuffles_dropped

__all__ = ["blocks", "discard", "map_arrow", "map_batches", "map_groups", "merged_in_tree", "named", "persisted", "shuffles_dropped", "table", "text_bytes"]

#: Bytes of text that a Python worker handles at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes of a record batch between Spark and Python, at most (a longer row is a batch of its own).
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows merged by one task of a tree.
FAN_IN = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _small_batches(spark: SparkSession) -> None:
    """By rows alone a batch of long texts would be tens of megabytes, several times over in either process."""
    now = int(spark.conf.get(_BATCH_CONF).rstrip("bB"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


_released = 0.0


def _release(pause: float = 0.0) -> None:
    """Gives freed memory back to the system, which a worker that waits for its next task would keep."""
    global _released
    now = time.monotonic()
    if now - _released >= pause:
        _released = now
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of a task's record batches."""
    _small_batches(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        _release()

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one record batch."""

    def run(batches):
        for b in batches:
            out = fn(b)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out

    return map_batches(df, run, schema)


def map_groups(spark: SparkSession, groups: GroupedData, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``applyInArrow`` with a function of a group's table."""
    _small_batches(spark)

    def run(t: pa.Table) -> pa.Table:
        out = fn(t)
        _release(pause=1.0)
        return out

    return groups.applyInArrow(run, schema)


def merged_in_tree(parts: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table], schema: str, tasks: int) -> DataFrame:
    """Rows of ``parts`` (with ``task``, a number below ``tasks``) merged to one for each of ``keys``, at most ``FAN_IN`` tasks' rows at a time.

    ``fn`` merges a group to one row that keeps its keys and some ``task`` of the group.
    """
    width = FAN_IN
    while True:
        parts = map_groups(parts.sparkSession, parts.groupBy(*keys, F.floor(F.col("task") / width).cast("int")), fn, schema)
        if width >= tasks:
            return parts
        width *= FAN_IN


def named(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """``df`` with a 64-bit name of the values of some columns: different values never have the same.

    Names are hashes. Those that two values share, found by a second hash, are few
    (about 70 among 5e10 values) and are replaced by others until none is shared.
    """
    values = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]
    made, second, again = F.xxhash64(*values), F.xxhash64(F.lit("second"), *values), 0
    while True:
        both = df.select(made.alias("n"), second.alias("s")).groupBy("n").agg(F.min("s").alias("a"), F.max("s").alias("z"))
        shared = [r.n for r in both.where("a <> z").select("n").collect()]
        if not shared:
            return df.withColumn(name, made)
        again += 1
        made = F.when(made.isin(shared), F.xxhash64(F.lit(again), *values)).otherwise(made)


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes; at least a row each."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
    cut = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        base = cut[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(cut, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch in UTF-8; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]
