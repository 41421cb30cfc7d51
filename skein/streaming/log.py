"""Change logs as streams: rolled-up and list state, followed live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..changes import LOG_SCHEMA
from ..operators import lists
from ..operators.rollups import merge_rollups, rollup
from ..sources.tables import shared_folder
from .versions import VersionedTable


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The operations appended to a log, as they come."""
    return spark.readStream.schema(LOG_SCHEMA).parquet(folder)


def follow(spark: SparkSession, folder: str, call: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Calls with each batch of new operations; what was seen is kept in ``checkpoint``, so that a restart goes on there."""
    return _started(read_log(spark, folder), call, checkpoint, once)


def _started(rows: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class LiveRollup:
    """Aggregates by parent kept up to date over a stream of rows (parent, value).

    Each batch is summed and merged with the buckets of parents that it touches, and
    only these are written again. Integers (``kind`` bigint) are summed exactly, as
    decimals; doubles as doubles.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, kind: str = "double"):
        if kind not in ("double", "bigint"):
            raise ValueError("kind is double or bigint")
        self.kind, self.total = kind, "double" if kind == "double" else "decimal(38,0)"
        schema = f"parent bigint, n bigint, total {self.total}, lo {kind}, hi {kind}, nulls bigint"
        self._table = VersionedTable(spark, folder or shared_folder(spark), schema, "parent")

    def read(self) -> DataFrame:
        return self._table.read()

    def add(self, batch: DataFrame, batch_id: int) -> None:
        new = rollup(batch.select(F.col("parent").cast("bigint").alias("parent"), F.col("value").cast(self.kind).alias("value")), "parent", "value")
        new = new.withColumn("total", F.col("total").cast(self.total))
        touched = self._table.touched(new)
        merged = merge_rollups(self._table.read(batch_id, touched), new).withColumn("total", F.col("total").cast(self.total))
        self._table.write(batch_id, merged, touched)

    def start(self, rows: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        return _started(rows, self.add, checkpoint, once)


class LiveLists:
    """Sequences of list groups (grp, item, list_index) kept up to date over a stream of list operations.

    Operations are those of ``lists.replay``, each batch's ordered by seq within a
    group; groups in buckets that a batch doesn't touch aren't read.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self._table = VersionedTable(spark, folder or shared_folder(spark), "grp bigint, item bigint, list_index bigint", "grp")

    def read(self) -> DataFrame:
        return self._table.read()

    def add(self, batch: DataFrame, batch_id: int) -> None:
        touched = self._table.touched(batch)
        self._table.write(batch_id, lists.replay(self._table.read(batch_id, touched), batch), touched)

    def start(self, operations: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        return _started(operations, self.add, checkpoint, once)


def latest_values(log: DataFrame) -> DataFrame:
    """item, col and the last newv of a stream of cell updates (seq, item, col, newv): a stateful aggregate, in update mode."""
    return log.groupBy("item", "col").agg(F.max_by("newv", "seq").alias("value"), F.max("seq").alias("seq"))
