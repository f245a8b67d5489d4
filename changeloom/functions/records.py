"""Column expressions for records: sizes, checksums, names and key rules. All are built-in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the record format: bytes before key and value, and the stored form of a deletion.
HEADER_BYTES = 12
TOMBSTONE = "__TOMBSTONE__"
RESERVED_KEYS = ("__CHECKPOINT__", TOMBSTONE)


def record_size(key: Column, value: Column, is_delete: Column) -> Column:
    """Bytes of a record in a flushed run, where a deletion is stored as its marker."""
    stored = F.when(is_delete, F.lit(len(TOMBSTONE))).otherwise(F.coalesce(F.octet_length(value), F.lit(0)))
    return (F.lit(HEADER_BYTES) + F.octet_length(key) + stored).cast("long")


def valid_key(key: Column) -> Column:
    """Not null and not reserved; an empty key is valid."""
    return key.isNotNull() & ~key.cast("binary").isin(*(F.lit(k).cast("binary") for k in RESERVED_KEYS))


def checksum(data: Column) -> Column:
    """CRC-32 (IEEE) of bytes."""
    return F.crc32(data.cast("binary"))


def little_endian(number: Column, size: int) -> Column:
    """The lowest `size` bytes of a number, lowest first."""
    digits = F.lpad(F.hex(number.cast("long")), 16, "0")
    parts = [F.substring(digits, 15 - 2 * k, 2) for k in range(size)]
    return F.unhex(F.concat(*parts))


def from_little_endian(data: Column, size: int) -> Column:
    """The number of `size` (up to 7, or 8 below 2**63) little-endian bytes."""
    digits = F.hex(data)
    return F.conv(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size)))), 16, 10).cast("long")


def record_bytes(key: Column, value: Column) -> Column:
    """A record as it is stored: checksum, key length, value length, key, value."""
    k, v = key.cast("binary"), value.cast("binary")
    body = F.concat(little_endian(F.octet_length(k), 4), little_endian(F.octet_length(v), 4), k, v)
    return F.concat(little_endian(F.crc32(body), 4), body)


def record_checksum(key: Column, value: Column) -> Column:
    k, v = key.cast("binary"), value.cast("binary")
    return F.crc32(F.concat(little_endian(F.octet_length(k), 4), little_endian(F.octet_length(v), 4), k, v))


def file_name(kind: str, number: Column) -> Column:
    """`segment-000007` and the like."""
    return F.concat(F.lit(f"{kind}-"), F.lpad(number.cast("string"), F.greatest(F.lit(6), F.length(number.cast("string"))), F.lit("0")))


def number_of(path: Column, kind: str) -> Column:
    """The number in a file name of that kind, null if it is none."""
    digits = F.regexp_extract(path, rf"(?:^|/){kind}-(\d+)$", 1)
    return F.when(digits != "", digits.cast("long"))
