"""Bounded, repeatable samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes beyond this number are refused: labels are few, whatever the corpus size.
MAX_CLASSES = 1000


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of doc_id as text, modulo `by`."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def class_counts(rows: DataFrame, label: str) -> dict:
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().limit(MAX_CLASSES + 1).collect()}
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"over {MAX_CLASSES} classes")
    return counts


def pick(rows: DataFrame, label: str, counts: dict, per_class: int, key: str = "doc_id") -> DataFrame:
    """About `per_class` rows of each class (all of a smaller one), chosen by a hash of the key; at most 1.5 times as many."""
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(share)
    even = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(F.col(label).isNotNull() & (even < share)).limit(int(1.5 * per_class * max(1, len(counts))) + 100)


def within_bytes(texts: DataFrame, sample: DataFrame, classes: int, most_bytes: int) -> DataFrame:
    """Of sample (of, label; few rows, one for each id) the rows whose texts (of, text, ...) hold at most `most_bytes` together.

    Each class has its share of the bytes. Where they do not suffice, rows are taken in the order of a hash of the
    id as far as they fit; an id with more text than the share, by a long text or by many rows, is left out. A row
    for each sampled id comes to the driver.
    """
    of, label = F.col("of"), F.col("label")
    sizes = texts.join(F.broadcast(sample), "of").groupBy("of", "label").agg(F.sum(F.octet_length("text")).alias("size"))
    got = sizes.select("of", "label", "size", F.xxhash64("of", F.lit(23)).alias("turn")).toArrow().sort_by([("turn", "ascending"), ("of", "ascending")])
    room, keep = {}, []
    for key, kind, size in zip(*(got.column(c).to_pylist() for c in ("of", "label", "size")), strict=True):
        left = room.setdefault(kind, most_bytes // max(1, classes))
        if size <= left:
            room[kind] = left - size
            keep.append((key, kind))
    return sample.sparkSession.createDataFrame(keep, sample.select(of, label).schema)
