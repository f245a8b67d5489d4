"""A changelog and its current state.

A changelog is a DataFrame of (key, value, is_delete, seq, ...): the newest version of a key is the
one with the greatest seq; a key whose newest version is a deletion is absent. Keys and values may be
binary or strings (both compare as unsigned bytes).

Every operator is a plan of built-in operators. Filters on keys are written above the newest-wins step
and are pushed below it into the scan, since the key is what that step partitions by; comparing with a
literal of the key's own type keeps them in PushedFilters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import bounds, free_name, range_of


def newest(log: DataFrame, *keys: str, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The newest version of each key, deletions included; `order` is not null and differs between a key's versions.

    An aggregate, combined before the shuffle: each task sends one row per key, a hot key too. (A
    window sorts by key and version instead of by key alone and takes about twice as long; a hash
    aggregate of versions joined back has to shuffle the whole log.) Select the needed columns first:
    the aggregate carries all it is given.
    """
    keys = keys or ("key",)
    rest = [c for c in log.columns if c not in keys]
    version = F.struct(*order) if len(order) > 1 else F.col(order[0])
    top = free_name(log, "__top")
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias(top))
    return best.select(*(F.col(c) if c in keys else F.col(f"{top}.{c}").alias(c) for c in log.columns))


def drop_deleted(rows: DataFrame) -> DataFrame:
    """Only after `newest`: a deletion must first hide what is older."""
    return rows.where(~F.col("is_delete"))


def current_state(log: DataFrame) -> DataFrame:
    """(key, value, seq) of all present keys."""
    return drop_deleted(newest(log.select("key", "value", "is_delete", "seq"))).select("key", "value", "seq")


def _literal(df: DataFrame, value) -> Column:
    return F.lit(value).cast(df.schema["key"].dataType)


def in_range(rows: DataFrame, low=None, high=None) -> DataFrame:
    """Keys in the half-open range [low, high); None leaves a side open, low >= high is empty."""
    if low is not None:
        rows = rows.where(F.col("key") >= _literal(rows, low))
    return rows if high is None else rows.where(F.col("key") < _literal(rows, high))


def point_get(log: DataFrame, key) -> DataFrame:
    return current_state(log.where(F.col("key") == _literal(log, key)))


def multi_get(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """State of the keys in `wanted` (key, ...); the semi-join stands below newest-wins, so other keys are never sorted."""
    return current_state(log.join(wanted.select("key").distinct(), "key", "left_semi"))


def range_scan(log: DataFrame, low=None, high=None) -> DataFrame:
    return current_state(in_range(log, low, high))


def lower_bound(log: DataFrame, target) -> DataFrame:
    """The first present key >= target."""
    return range_scan(log, target).orderBy("key").limit(1)


def ordered(state: DataFrame) -> DataFrame:
    """All present keys in byte order: range-partitioned and sorted, as `orderBy` does."""
    return state.orderBy("key")


def with_position(state: DataFrame, parts: int | None = None) -> DataFrame:
    """state with `pos`, the 1-based rank of its (distinct) key, without moving all rows to one task: rows are ranked within key ranges of fixed bounds, whose few sizes are added up."""
    parts = parts or int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts, own = bounds(state, parts), free_name(state, "__range")
    rows = state.withColumn(own, range_of(F.col("key"), state.schema["key"].dataType, cuts))
    sizes = rows.groupBy(own).agg(F.count("*").alias("__count"))  # a row per range
    before = sizes.select(own, (F.sum("__count").over(Window.orderBy(own)) - F.col("__count")).alias("__before"))
    ranked = rows.withColumn("pos", F.row_number().over(Window.partitionBy(own).orderBy("key")).cast("long"))
    return ranked.join(F.broadcast(before), own).select(*state.columns, (F.col("__before") + F.col("pos")).alias("pos"))


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """State when `seq` was the newest version."""
    return current_state(log.where(F.col("seq") <= seq))


def overlay(state: DataFrame, buffer: DataFrame) -> DataFrame:
    """A transaction's view: its buffered writes (key, value, is_delete) hide the store's rows, deletions too."""
    kept = state.select("key", "value").join(buffer.select("key"), "key", "left_anti")
    return kept.unionByName(drop_deleted(buffer).select("key", "value"))


def merge_runs(runs: DataFrame, keep_deleted: bool = False) -> DataFrame:
    """Newest-wins merge of runs (source_priority 0 = newest, key, value, is_delete)."""
    out = newest(runs.withColumn("__age", -F.col("source_priority")), order=("__age",)).drop("__age")
    return out if keep_deleted else drop_deleted(out)
