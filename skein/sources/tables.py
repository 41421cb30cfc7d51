"""Parquet in and out, and the shared store for results between jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..errors import StorageError

#: Schemas of tables that this application has read, so that later reads need no look at a file's footer.
_schemas: dict[tuple[str, str], StructType] = {}
#: Spark's option by which an execution's shuffle files go when it ends, instead of when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, under ``spark.checkpoint.dir``.

    Without the setting a session in one process gets a folder under its warehouse;
    any other is refused, since its executors share no folder that is known here.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise StorageError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{root.rstrip('/')}/skein-{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def persisted(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes rows to the shared store and reads them again.

    The files go with ``discard`` or, at the latest, when the application ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    files, at = _located(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of frames that ``persisted`` gave; nothing may read them any more."""
    for df in frames:
        if path := getattr(df, "_skein_folder", None):
            files, at = _located(df.sparkSession, path)
            files.delete(at, True)
            files.cancelDeleteOnExit(at)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, an execution's shuffle files go at its end; for steps that are ``persisted``, since nothing reads those files again.

    A frame that is handed on should be made outside, or what runs it twice shuffles twice.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
