"""The commit log: batches of operations, replay, torn tails, rollbacks and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import newest


def commit_batches(writes: DataFrame) -> DataFrame:
    """(txn_id, seq, ops): one atomic record for each transaction, with the last write of each of its keys in key order."""
    last = newest(writes, "txn_id", "key")
    ops = F.array_sort(F.collect_list(F.struct("key", "value", "is_delete", "seq")))
    return last.groupBy("txn_id").agg(F.max("seq").alias("seq"), ops.alias("ops"))


def explode_ops(commits: DataFrame) -> DataFrame:
    """The operations of commit records as changelog rows."""
    return commits.select("txn_id", F.explode("ops").alias("op")).select("txn_id", "op.key", "op.value", "op.is_delete", "op.seq")


def readable(log: DataFrame) -> DataFrame:
    """Log rows (wal_id, seq, checksum_ok, ...) up to the first bad record of the last file.

    A bad record in an earlier file is an error, raised when the plan runs; a torn tail of the last
    file is what a crash leaves, and ends the log.
    """
    place = F.struct("wal_id", "seq")
    ends = log.agg(F.min(F.when(~F.col("checksum_ok"), place)).alias("__bad"), F.max("wal_id").alias("__last"))  # one row
    at = F.col("__bad")
    early = F.raise_error(F.concat(F.lit("bad record in log file "), at["wal_id"].cast("string")))
    kept = F.when(at["wal_id"] < F.col("__last"), early.cast("boolean")).otherwise(at.isNull() | (place < at))
    return log.crossJoin(F.broadcast(ends)).where(kept).select(*log.columns)


def replay(ops: DataFrame) -> DataFrame:
    """State after all operations (wal_id, seq, key, value, is_delete) in log order."""
    last = newest(ops, "key", order=("wal_id", "seq"))
    return last.where(~F.col("is_delete")).select("key", "value", "wal_id", "seq")


def committed(ops: DataFrame, aborted: DataFrame) -> DataFrame:
    """Operations without those of rolled-back transactions."""
    return ops.join(aborted.select("txn_id").distinct(), "txn_id", "left_anti")


def write_conflicts(writes: DataFrame, span: int) -> DataFrame:
    """(key, first_txn, second_txn): pairs of neighbouring writers of a key among transactions that run at the same time (txn_id div span equal).

    Of n writers of one key, n - 1 pairs of neighbours in commit order suffice: each must be ordered after the one before.
    """
    from pyspark.sql import Window

    at = F.floor(F.col("txn_id") / span)
    w = Window.partitionBy("key", "epoch").orderBy("txn_id")
    own = writes.select("key", "txn_id", at.alias("epoch")).distinct()
    pairs = own.withColumn("second_txn", F.lead("txn_id").over(w)).where("second_txn is not null")
    return pairs.select("key", F.col("txn_id").alias("first_txn"), "second_txn")
