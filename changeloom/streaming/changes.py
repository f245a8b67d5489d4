"""A changelog as a stream: files that arrive in a folder, folded into a state or appended to a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.state import current_state, newest


def newest_stream(changes: DataFrame) -> DataFrame:
    """The newest version of each key so far, as a streaming aggregate (update or complete mode): one state row per key, combined before the shuffle."""
    return changes.groupBy("key").agg(F.max_by(F.struct("value", "is_delete", "seq"), "seq").alias("top")).select("key", "top.value", "top.is_delete", "top.seq")


#: After so many batches their runs are merged into one.
MERGE_BATCHES = 16


class Fold:
    """The state of a stream as runs in a folder of any file system that Spark reaches.

    A batch leaves one run: the newest version of each of its keys, deletions kept. Every MERGE_BATCHES batches all
    runs are merged, so few are read. A batch that is run again after a failure replaces its own run; a late row
    with an older seq loses. Rows never come to the driver.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self, kind: str) -> list[int]:
        """Numbers of the whole runs of a kind, ascending."""
        names = [s.getPath().getName() for s in self._fs.globStatus(self._path(f"{kind}-*")) or []]
        return sorted(int(n.split("-")[1]) for n in names if self._fs.exists(self._path(f"{n}/_SUCCESS")))

    def log(self, schema: T.StructType) -> DataFrame:
        merged = self._done("merged")[-1:]
        runs = [f"{self.folder}/merged-{k}" for k in merged]
        runs += [f"{self.folder}/batch-{k}" for k in self._done("batch") if not merged or k > merged[0]]
        return self.spark.read.schema(schema).parquet(*runs) if runs else self.spark.createDataFrame([], schema)

    def apply(self, rows: DataFrame, number: int) -> None:
        if number <= max(self._done("merged"), default=-1):
            return  # merged already
        rows = newest(rows.select("key", "value", "is_delete", "seq"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch-{number}")
        old = self._done("batch")
        if len(old) >= MERGE_BATCHES:
            earlier = self._done("merged")
            newest(self.log(rows.schema)).write.mode("overwrite").parquet(f"{self.folder}/merged-{number}")
            for name in [*(f"batch-{k}" for k in old), *(f"merged-{k}" for k in earlier)]:
                self._fs.delete(self._path(name), True)


def drain(changes: DataFrame, folder: str, trigger: dict | None = None) -> DataFrame:
    """Runs a streaming changelog to its present end and returns the state as a batch DataFrame; a later call with the same folder goes on from there."""
    fold = Fold(changes.sparkSession, f"{folder}/runs")
    query = changes.writeStream.foreachBatch(fold.apply).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return current_state(fold.log(changes.select("key", "value", "is_delete", "seq").schema))


def read_changes(spark: SparkSession, folder: str, schema, to_changes: Callable[[DataFrame], DataFrame], pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream of changelog rows."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return to_changes(reader.parquet(folder))
