"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

All steps are DataFrame aggregates with map-side combine, so a group of any size is a running
(count, max) in each task and one small row per task in the shuffle. Full content is hashed only
for rows whose (length, prefix hash) occurs more than once, or once for each row if its hash is asked for. Rows get back what their group came to
by joins: lists of keys within a checked size, and the largest groups, are broadcast; the rest is
joined by a shuffle in which no key has HOT_ROWS rows or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Workspace, broadcast_if_small, join_groups

PREFIX_CHARS = 64
HOT_ROWS = 1000


def _size_and_prefix(text: Column) -> list[Column]:
    return [F.octet_length(text).alias("size"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix")]


def _grouped(docs: DataFrame, digests: bool = False) -> DataFrame:
    """(doc_id, size, prefix, keep_id, group_size), a row for each row of docs; with its text's SHA-256 in full, if asked for."""
    work = Workspace(docs.sparkSession, "exact-dedup")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # lengths that occur once are settled; then prefix hashes
    digest = F.unhex(F.sha2("text", 256)).alias("full")
    cheap = work.write(rows.select("doc_id", *_size_and_prefix(F.col("text")), *([digest] if digests else [])), "cheap")
    sizes = work.write(cheap.groupBy("size").agg(F.count("*").alias("c")).where("c > 1").select("size"), "sizes")
    pairs = cheap.join(broadcast_if_small(sizes), "size", "left_semi").groupBy("size", "prefix").agg(F.count("*").alias("c")).where("c > 1").select("size", "prefix")
    pairs = work.write(pairs, "pairs")
    # full content of the survivors only
    keyed = cheap if digests else rows.select("doc_id", *_size_and_prefix(F.col("text")), "text")
    survivors = keyed.join(broadcast_if_small(pairs), ["size", "prefix"], "left_semi")
    full = work.write(survivors.select("doc_id", "size", "prefix", "full" if digests else digest), "full")
    groups = work.write(full.groupBy("full", "size").agg(F.max("doc_id").alias("keep_id"), F.count("*").cast("long").alias("group_size")), "groups")
    alone = cheap.join(broadcast_if_small(pairs), ["size", "prefix"], "left_anti").select("doc_id", "size", "prefix", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *(["full"] if digests else []))
    return alone.unionByName(join_groups(full, groups, ["full", "size"], "group_size", hot=HOT_ROWS).select(*alone.columns))


def exact_duplicates(docs: DataFrame, digests: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id long, keep_id long, group_size long, kept boolean), a row for each row of docs.

    digests adds text_sha256, the text's SHA-256 in hexadecimal digits.

    Texts are equal when identical byte for byte; null counts as empty. Of equal texts the largest
    doc_id stays; rows that repeat it with the same text are all marked as kept. A row without doc_id
    is never kept if its text has another row with one, and has a null in kept if not. Other columns are
    ignored.
    """
    kept = F.when(F.col("keep_id").isNotNull(), F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept")
    return _grouped(docs, digests).select("doc_id", "keep_id", "group_size", kept, *([F.lower(F.hex("full")).alias("text_sha256")] if digests else []))


def exact_duplicate_filter(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row with a larger doc_id has too; all columns are kept.

    Rows without doc_id stay. Rows that repeat the doc_id and the text of a kept row stay too: they are
    the same document given again.
    """
    gone = _grouped(docs).where(F.col("doc_id") < F.col("keep_id")).select(F.col("doc_id").alias("__gone"), F.col("size").alias("__size"), F.col("prefix").alias("__prefix"))
    size, prefix = _size_and_prefix(F.coalesce(docs["text"].cast("string"), F.lit("")))
    gone = broadcast_if_small(Workspace(docs.sparkSession, "exact-gone").write(gone, "gone"))
    return docs.join(gone, (docs["doc_id"] == gone["__gone"]) & (size == gone["__size"]) & (prefix == gone["__prefix"]), "left_anti")
