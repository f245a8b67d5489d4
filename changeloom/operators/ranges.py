"""Key ranges with fixed bounds: the same rows are in the same range wherever the plan is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_PER_RANGE = 32
MOST_RANGES = 1024


def bounds(rows: DataFrame, ranges: int, key: str = "key") -> list:
    """At most ranges - 1 keys, ascending, that cut the keys into ranges of about the same number of different keys.

    They come from the keys with the smallest hashes: a top-k of bounded size (SAMPLE_PER_RANGE for each range, MOST_RANGES
    at most), the same in every run. A key with many rows may fill the sample; then there are fewer ranges.
    """
    ranges = min(ranges, MOST_RANGES)
    if ranges < 2:
        return []
    some = rows.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key)).limit(ranges * SAMPLE_PER_RANGE).collect()
    keys = sorted({bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in some}, key=lambda k: k.encode() if isinstance(k, str) else k)
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}, key=keys.index) if keys else []


def range_of(key: Column, kind, cuts: list) -> Column:
    """The number of cuts <= key, by binary search; `kind` is the key's data type."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]).cast(kind), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(cuts)).cast("int")


def free_name(df: DataFrame, stem: str) -> str:
    """`stem`, made longer until df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem
