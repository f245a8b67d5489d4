"""Sorted runs: flush, manifest, sparse index, lookups by interval, and the steps of a compaction.

A run row is (segment_id, key, value, is_delete, seq); a manifest row is (segment_id, level, min_key,
max_key, n_records, bytes).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import record_size
from .ranges import bounds, range_of
from .state import drop_deleted, newest

L0_TRIGGER = 4  #: runs in level 0 that start a compaction


def flush(log: DataFrame) -> DataFrame:
    """The newest version of each key within each segment, deletions kept: what a memtable flush writes."""
    return newest(log, "segment_id", "key")


def manifest(runs: DataFrame, level: int = 0) -> DataFrame:
    size = record_size(F.col("key"), F.col("value"), F.col("is_delete"))
    return runs.groupBy("segment_id").agg(F.lit(level).alias("level"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n_records"), F.sum(size).alias("bytes"))


def sparse_index(runs: DataFrame, every: int = 2) -> DataFrame:
    """(segment_id, key, offset) of every `every`-th record of each run; the offset is the bytes of the records before it.

    A run is bounded by the size at which it is split, so a window over one is bounded too.
    """
    w = Window.partitionBy("segment_id").orderBy("key")
    sized = runs.withColumn("size", record_size(F.col("key"), F.col("value"), F.col("is_delete")))
    rows = sized.select("segment_id", "key", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("offset"), F.row_number().over(w).alias("rn"))
    return rows.where((F.col("rn") - 1) % every == 0).select("segment_id", "key", "offset")


def sparse_index_of_files(rows: DataFrame, every: int = 2) -> DataFrame:
    """The same of one run that is cut into files with disjoint key ranges: (file, segment_id, before, start, key, value, is_delete), `before` and `start` the records and bytes of the run before the file.

    A file is bounded by the size at which it is cut, so a window over one is bounded too.
    """
    w = Window.partitionBy("file").orderBy("key")
    sized = rows.withColumn("size", record_size(F.col("key"), F.col("value"), F.col("is_delete")))
    offset = F.col("start") + F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = sized.select("segment_id", "key", offset.cast("long").alias("offset"), (F.col("before") + F.row_number().over(w)).alias("rn"))
    return numbered.where((F.col("rn") - 1) % every == 0).select("segment_id", "key", "offset")


#: Up to so many runs are broadcast.
BROADCAST_RUNS = 100_000


def sparse_floor(index: DataFrame, wanted: DataFrame, ranges: int | None = None) -> DataFrame:
    """(segment_id, key, offset) for each wanted key and run: the offset of the greatest indexed key <= key, -1 if there is none.

    An as-of join without a range join: in each key range of each run, wanted keys and index entries are sorted
    together and the last offset before each key is carried forward; what earlier ranges of the run end with is
    carried into the next ones, a row for each. So a task has one range of one run, however many keys are asked for.
    """
    ranges = ranges or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts, kind = bounds(index, ranges), index.schema["key"].dataType
    segments = index.select("segment_id").distinct()
    few = segments.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS
    keys = wanted.select("key").where("key is not null").distinct()
    asked = keys.crossJoin(F.broadcast(segments) if few else segments)  # the result has a row for each
    entries = index.select("segment_id", "key", "offset", F.lit(0).alias("asked"))
    both = entries.unionByName(asked.select("segment_id", "key", F.lit(None).cast("long").alias("offset"), F.lit(1).alias("asked"))).withColumn("range", range_of(F.col("key"), kind, cuts))
    ends = both.groupBy("segment_id", "range").agg(F.max_by("offset", F.when(F.col("asked") == 0, F.col("key"))).alias("end"))
    before = Window.partitionBy("segment_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("segment_id", "range", F.last("end", ignorenulls=True).over(before).alias("carry"))
    w = Window.partitionBy("segment_id", "range").orderBy("key", "asked").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("offset", F.last("offset", ignorenulls=True).over(w)).where("asked = 1")
    return found.join(carried, ["segment_id", "range"]).select("segment_id", "key", F.coalesce("offset", "carry", F.lit(-1)).cast("long").alias("offset"))


def interval_prune(keys: DataFrame, runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(key, segment_id, level) of the runs whose [min_key, max_key] holds the key.

    Keys are cut into ranges at the runs' least keys, and a run stands in each range that it reaches, so the join is
    one on the range's number; only runs and keys of one range are compared.
    """
    ranges = ranges or 4 * int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts, kind = bounds(runs, ranges, "min_key"), runs.schema["min_key"].dataType
    first, last = (range_of(F.col(c), kind, cuts) for c in ("min_key", "max_key"))
    spread = runs.where("min_key <= max_key").select("segment_id", "level", "min_key", "max_key", F.explode(F.sequence(first, last)).alias("range"))
    asked = keys.select("key").distinct().withColumn("range", range_of(F.col("key"), kind, cuts))
    hit = (F.col("min_key") <= F.col("key")) & (F.col("key") <= F.col("max_key"))
    return asked.join(spread, "range").where(hit).select("key", "segment_id", "level")


def overlapping(runs: DataFrame, strict: bool = False) -> DataFrame:
    """(left_id, right_id) of runs of one level whose intervals overlap; strict: ranges that only touch do not."""
    a = runs.select(F.col("segment_id").alias("left_id"), F.col("level"), F.col("min_key").alias("a_min"), F.col("max_key").alias("a_max"))
    b = runs.select(F.col("segment_id").alias("right_id"), F.col("level").alias("b_level"), F.col("min_key").alias("b_min"), F.col("max_key").alias("b_max"))
    meets = (F.col("a_max") > F.col("b_min")) & (F.col("b_max") > F.col("a_min")) if strict else (F.col("a_max") >= F.col("b_min")) & (F.col("b_max") >= F.col("a_min"))
    return a.join(b, (F.col("level") == F.col("b_level")) & (F.col("left_id") < F.col("right_id")) & meets).select("left_id", "right_id")


def compaction_triggers(runs: DataFrame, max_bytes: int, l0_runs: int = L0_TRIGGER) -> DataFrame:
    """(level, n_segments, bytes, triggered): level 0 by its number of runs or bytes, deeper ones by bytes."""
    sums = runs.groupBy("level").agg(F.count("*").alias("n_segments"), F.sum("bytes").cast("long").alias("bytes"))
    by_count = (F.col("level") == 0) & (F.col("n_segments") >= l0_runs)
    return sums.withColumn("triggered", by_count | (F.col("bytes") >= max_bytes))


def compaction_inputs(runs: DataFrame, level: int) -> DataFrame:
    """The runs that a compaction of `level` reads: all of level 0, or a deeper level's first run; and the runs of the next level that overlap them."""
    base = runs.where(F.col("level") == level)
    if level:
        base = base.orderBy("min_key", "segment_id").limit(1)
    span = base.select("min_key", "max_key").agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi"))
    below = runs.where(F.col("level") == level + 1).join(F.broadcast(span), (F.col("max_key") >= F.col("lo")) & (F.col("min_key") <= F.col("hi"))).drop("lo", "hi")
    return base.unionByName(below)


def compact(rows: DataFrame, bottom: bool = True) -> DataFrame:
    """Newest version of each key over the inputs' rows; deletions go only if no deeper level can hold the key."""
    merged = newest(rows.select("key", "value", "is_delete", "seq"))
    return drop_deleted(merged) if bottom else merged


def merge_stats(rows: DataFrame) -> DataFrame:
    """One row: records read, older duplicates, deletions that hide a key, records that stay."""
    per = rows.groupBy("key").agg(F.count("*").alias("c"), F.max(F.struct("seq", "is_delete")).alias("top"))
    gone = F.when(F.col("top.is_delete"), 1).otherwise(0)
    return per.agg(F.sum("c").cast("long").alias("n_input"), F.sum(F.col("c") - 1).cast("long").alias("n_duplicates"), F.sum(gone).cast("long").alias("n_deleted"), F.sum(1 - gone).cast("long").alias("n_output"))


def _fold(threshold: int):
    """The greedy rule over rows in order of range and key: a new part if the open one is not empty and would get over the threshold; each range begins anew."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = offset = 0
        own = None
        for frame in frames:
            parts, offsets = [], []
            for at, size in zip(frame["range"].tolist(), frame["size"].tolist(), strict=True):
                if at != own:
                    own, part, offset = at, 0, 0
                if offset and offset + size > threshold:
                    part, offset = part + 1, 0
                parts.append(part)
                offsets.append(offset)
                offset += size
            yield frame.assign(part=parts, offset=offsets)

    return run


def _split(rows: DataFrame, threshold: int, at: Column, tasks: int) -> DataFrame:
    kind = rows.schema["key"].dataType.simpleString()
    sized = rows.select("key", record_size(F.col("key"), F.col("value"), F.col("is_delete")).alias("size"), at.alias("range"))
    return sized.repartition(tasks, "range").sortWithinPartitions("range", "key").mapInPandas(_fold(threshold), f"key {kind}, size long, range int, part int, offset long")


def split(rows: DataFrame, threshold: int) -> DataFrame:
    """(key, size, part, offset): live rows cut into parts of at most `threshold` bytes, each part as long as it can be.

    Where a part ends depends on all rows before it, so one task streams the (key, size) pairs in key
    order, in constant memory. `split_in_ranges` cuts in parallel, with a cut at each range's edge.
    """
    return _split(rows, threshold, F.lit(0), 1).drop("range")


def split_in_ranges(rows: DataFrame, threshold: int, ranges: int, cuts: list | None = None) -> DataFrame:
    """The same within each of `ranges` key ranges, in tasks of their own: (key, size, range, part, offset); the ranges begin at `cuts`, ascending, if given."""
    cuts = bounds(rows, ranges) if cuts is None else cuts
    return _split(rows, threshold, range_of(F.col("key"), rows.schema["key"].dataType, cuts), max(1, len(cuts) + 1))


def new_layout(old: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """The manifest without the compacted runs and with the new ones."""
    return old.join(gone.select("segment_id"), "segment_id", "left_anti").unionByName(new)


def serving_run(runs: DataFrame) -> DataFrame:
    """(key, segment_id, is_delete): the run whose version of each key answers a lookup."""
    return newest(runs.select("key", "segment_id", "is_delete", "seq")).select("key", "segment_id", "is_delete")
