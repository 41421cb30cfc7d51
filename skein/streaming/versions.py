"""A table in buckets of a key, of which each batch of a stream rewrites those that it touches.

A batch writes its buckets under its own number, and then a manifest that names for
each bucket the batch that wrote it last. A batch that is run again after a failure
reads the manifest before its own, and so makes the same version again; nothing
counts twice. What neither of the last two manifests names is deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets
        self.schema = StructType.fromDDL(schema)
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._files = jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _manifests(self) -> list[int]:
        at = self._path(f"{self.folder}/manifests")
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(at)) if self._files.exists(at) else []

    def _manifest(self, batch: int) -> dict[int, int]:
        """Bucket to the batch that wrote it."""
        stream = self._files.open(self._path(f"{self.folder}/manifests/{batch}"))
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(raw).items()}

    def _before(self, batch: int | None) -> dict[int, int]:
        found = [m for m in self._manifests() if batch is None or m < batch]
        return self._manifest(found[-1]) if found else {}

    def read(self, batch: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The table before a batch, or now; of some buckets only."""
        paths = [f"{self.folder}/v{v}/_bucket={b}" for b, v in self._before(batch).items() if only is None or b in only]
        paths = [p for p in paths if self._files.exists(self._path(p))]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, rows: DataFrame) -> list[int]:
        return [r._bucket for r in self.bucket(rows).select("_bucket").distinct().collect()]  # as many as there are buckets, at most

    def write(self, batch: int, rows: DataFrame, touched: list[int]) -> None:
        """``rows`` are all rows of the touched buckets from now on."""
        before = self._before(batch)
        self.bucket(rows).repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/v{batch}")
        now = before | dict.fromkeys(touched, batch)
        out = self._files.create(self._path(f"{self.folder}/manifests/{batch}"), True)
        try:
            out.write(json.dumps(now).encode())
        finally:
            out.close()
        self._clean(batch, before, now)

    def _clean(self, batch: int, before: dict[int, int], now: dict[int, int]) -> None:
        held = set(before.values()) | set(now.values())
        for f in self._files.listStatus(self._path(self.folder)):
            name = f.getPath().getName()
            if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) < batch and int(name[1:]) not in held:
                self._files.delete(f.getPath(), True)
        for m in self._manifests()[:-2]:
            self._files.delete(self._path(f"{self.folder}/manifests/{m}"), False)
