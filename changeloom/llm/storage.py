"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a session on one machine (tests) takes one under the warehouse; a cluster is an error, as no other folder is known to be shared."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (known or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def fresh_name(taken: Iterable[str], stem: str) -> str:
    """`stem`, made longer until it is no column of `taken`, in whatever case."""
    low = {c.lower() for c in taken}
    while stem.lower() in low:
        stem += "_"
    return stem


ARROW_BATCH_BYTES = 4 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold at most about ARROW_BATCH_BYTES: texts differ much in length, so rows are no bound of a worker's memory.

    Plans run when the caller uses them, so the setting stays; a smaller one of the caller's is kept.
    """
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = conf.get(key, str(1 << 30))
    if not (now.isdigit() and 0 < int(now) <= ARROW_BATCH_BYTES):
        conf.set(key, str(ARROW_BATCH_BYTES))
    return df


#: Up to so many keys (at most 64 bytes each) are broadcast; longer lists are joined by a shuffle.
BROADCAST_KEYS = 250_000


def broadcast_if_small(keys: DataFrame, most: int | None = None) -> DataFrame:
    """keys (a written table), to be broadcast if there are few enough."""
    return F.broadcast(keys) if keys.count() <= (BROADCAST_KEYS if most is None else most) else keys


#: Groups of so many rows or more are joined by a broadcast, so that no task of a shuffle meets a larger one.
HOT_ROWS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, how: str = "inner", hot: int | None = None) -> DataFrame:
    """rows with the columns of their group (a written table, `size` its number of rows); how: inner or left_semi.

    The groups of at least `hot` rows are broadcast, as far as they are no more than BROADCAST_KEYS: with n rows
    there are at most n / hot of them, and `hot` grows until they fit.
    """
    hot = hot or HOT_ROWS
    while groups.where(F.col(size) >= hot).count() > BROADCAST_KEYS:
        hot *= 10
    large, rest = groups.where(F.col(size) >= hot), groups.where(F.col(size) < hot)
    cool = rows.join(F.broadcast(large.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(large), on, how).unionByName(cool.join(rest, on, how))


def release_memory() -> None:
    """Gives what Arrow, numpy and Python no longer use back to the system."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A partition function after which a reused worker keeps no memory that later tasks do not need."""

    def go(it):
        yield from run(it)
        release_memory()

    return go


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside it drop their shuffle files as they end; else these stay until the driver happens to collect its garbage, which larger inputs do not make more frequent."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_collectors: list[list[Workspace]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Drops, at its end, the tables of all operator calls made inside it: their results must be written by then."""
    mine: list[Workspace] = []
    _collectors.append(mine)
    try:
        yield
    finally:
        _collectors.remove(mine)
        for work in mine:
            work.drop()


class Workspace:
    """Tables of one operator call, as Parquet in the shared folder.

    Each write cuts the lineage: a lost executor costs at most the tasks of one step. Tables that
    later steps no longer need are dropped early to free disk. Results may be read from the rest, so it stays until
    the caller is done: calls inside `temporary()` drop theirs at its end.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        for mine in _collectors[-1:]:
            mine.append(self)

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        with shuffles_removed(self.spark):
            df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str | None = None) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
