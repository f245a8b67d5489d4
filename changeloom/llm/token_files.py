"""Token-id files: texts to ids by the tokenizers library, ids to canonical Huffman blocks, and back.

A token file set is a folder in any store that Spark reaches:

* `codebook`: one row (lengths binary): the code length of each id, from counts over all documents;
* `blocks`: one row for each block of whole documents, in ascending doc_id order by (shard, block):
  ahead (ids of its shard before it), total (its ids), doc_ids and n_tokens (int64 and int32 arrays,
  little-endian), checkpoints (uint16 array: bits of each segment) and bits (the coded ids);
* `shards`: base, the ids of all shards before each shard.

Shards are ranges of doc_id. Blocks decode independently of each other, and so do their segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .huffman import Codec, code_lengths
from .piececache import PieceCache
from .storage import Workspace, bound_batches
from .textbytes import arrow_texts, chunks

BLOCK_TOKENS = 1 << 16
TEXT_BYTES = 2 << 20  #: bytes of text whose distinct pieces are looked up at once
NO_ID = -(1 << 63)  #: stands for a missing doc_id, which comes first
_BLOCK = "shard int, block long, ahead long, total long, doc_ids binary, n_tokens binary, checkpoints binary, bits binary"
_loaded: dict[str, PieceCache] = {}


def _library(path: str) -> PieceCache:
    """Distinct pieces through the library: plain words of one pre-token many at a time, all others one by one."""
    if path in _loaded:
        return _loaded[path]
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    size = tok.get_vocab_size(with_added_tokens=True)
    closes = np.array([(tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([p.isalpha() and max(p) < "ɐ" and p == p.lower() for p in pieces], bool)
        words = [p for p, one in zip(pieces, plain, strict=True) if one]
        other = [p for p, one in zip(pieces, plain, strict=True) if not one]
        texts = [" ".join(words[i : i + 256]) for i in range(0, len(words), 256)]
        many = [np.array(e.ids, np.int32) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(many) if many else np.zeros(0, np.int32)
        ends = np.flatnonzero(closes[flat])
        if len(ends) != len(words):
            raise ValueError("a word is not one pre-token")
        alone = [np.array(e.ids, np.int32) for e in tok.encode_batch_fast(other, add_special_tokens=False)]
        count = np.zeros(len(pieces), np.int64)
        count[plain] = np.diff(ends, prepend=-1)
        count[~plain] = [len(a) for a in alone]
        out = np.zeros(int(count.sum()), np.int32)
        of_plain = np.repeat(plain, count)
        out[of_plain] = flat
        out[~of_plain] = np.concatenate(alone) if alone else flat[:0]
        return out, count

    _loaded[path] = PieceCache(encode)
    return _loaded[path]


def _tokenise(path: str, end_id: int | None):
    """Each document's ids, with a number of its own (row) that tells repeated doc_ids apart."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, row = _library(path), TaskContext.get().partitionId() << 40
        for batch in it:
            for i, part, po in chunks(*arrow_texts(batch.column("text")), TEXT_BYTES):
                ids, offs = cache.ids(part, po)
                n = np.diff(offs)
                if end_id is not None:
                    out = np.full(len(ids) + len(n), end_id, np.int32)
                    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                    ids, n = out, n + 1
                flat = ids.astype("<i4" if ids.max(initial=0) > 0xFFFF else "<u2")
                cuts = np.concatenate([[0], np.cumsum(n * flat.itemsize, dtype=np.int64)]).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(n)), pa.array(row + np.arange(len(n))), pa.array(n.astype(np.int32)), blobs], ["doc_id", "row", "n", "ids"])
                row += len(n)

    return run


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """The ids of a batch's documents, one after the other; each document's take two or four bytes an id."""
    n = batch.column("n").to_numpy()
    blobs = [np.frombuffer(b.as_buffer(), "<u2" if b.as_buffer().size == 2 * k else "<i4") for b, k in zip(batch.column("ids"), n.tolist(), strict=True)]
    return np.concatenate(blobs).astype(np.int32) if blobs else np.zeros(0, np.int32)


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(1, np.int64)
    for batch in it:
        c = np.bincount(_ids(batch), minlength=len(sums))
        c[: len(sums)] += sums
        sums = c
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["id", "c"])


def _pack(lengths):
    """Blocks of whole documents, in the order in which they come."""
    names = _BLOCK.replace(",", "").split()[::2]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard = Codec(lengths.value), TaskContext.get().partitionId()
        docs: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []
        block = total = ahead = 0

        def flush():
            nonlocal docs, counts, held, block, total, ahead
            bits, marks = code.encode(np.concatenate(held))
            blobs = (np.concatenate(docs).astype("<i8").tobytes(), np.concatenate(counts).astype("<i4").tobytes(), marks.astype("<u2").tobytes(), bits)
            numbers = (pa.array([shard], pa.int32()), *(pa.array([x], pa.int64()) for x in (block, ahead, total)))
            docs, counts, held, block, total, ahead = [], [], [], block + 1, 0, ahead + total
            return pa.RecordBatch.from_arrays([*numbers, *(pa.array([x], pa.binary()) for x in blobs)], names)

        for batch in it:
            n = batch.column("n").to_numpy()
            ends = np.cumsum(n, dtype=np.int64)
            flat, of, at = _ids(batch), batch.column("doc_id").to_numpy(), 0
            while at < len(n):
                # up to the document that fills the block
                before = int(ends[at - 1]) if at else 0
                to = min(len(n), int(np.searchsorted(ends, before + BLOCK_TOKENS - total)) + 1)
                docs.append(of[at:to])
                counts.append(n[at:to])
                held.append(flat[before : int(ends[to - 1])])
                total += int(ends[to - 1]) - before
                at = to
                if total >= BLOCK_TOKENS:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int | None = 2, work: Workspace | None = None) -> None:
    """docs (doc_id, text, ...) to a token file set in `folder`.

    Texts are encoded whole by the tokenizer `path` without special tokens; null counts as empty;
    `end_id` is appended to each document. Rows without doc_id come first; rows that repeat a doc_id are
    all written, in any order. Other columns are ignored; an empty table gives a set without blocks.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "token-files")
    # as many ranges as input splits: a shard is a task's share of the texts
    parts = max(1, docs.select("doc_id").rdd.getNumPartitions())
    rows = bound_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ids, not texts, go through the shuffle; rows of one doc_id may be in several ranges
    coded = work.write(rows.mapInArrow(_tokenise(path, end_id), "doc_id long, row long, n int, ids binary"), "coded")
    counted = coded.select("n", "ids").mapInArrow(_counts, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toArrow()  # at most as many rows as the vocabulary has ids
    counts = np.zeros(max(counted.column("id").to_pylist(), default=0) + 1, np.int64)
    counts[counted.column("id").to_numpy()] = counted.column("c").to_numpy()
    lengths = code_lengths(counts)
    ordered = coded.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    blocks = ordered.select("doc_id", "n", "ids").mapInArrow(_pack(spark.sparkContext.broadcast(lengths)), _BLOCK)
    blocks.write.mode("overwrite").option("compression", "none").parquet(f"{folder}/blocks")
    # one row for each shard, and the ids before it
    sums = sorted((r["shard"], r["n"]) for r in spark.read.schema(_BLOCK).parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("total").alias("n")).collect())
    base, bases = 0, []
    for shard, n in sums:
        bases.append((shard, base))
        base += n
    spark.createDataFrame(bases, "shard int, base long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/shards")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/codebook")
    work.drop("coded")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """A token file set -> (doc_id long, start long, n_tokens int, ids binary): ids as little-endian uint32, start the ids of all documents before it."""
    book = spark.read.parquet(f"{folder}/codebook").first()
    held = spark.sparkContext.broadcast(np.frombuffer(bytes(book["lengths"]), np.uint8))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Codec(held.value)
        for batch in it:
            for i in range(0, batch.num_rows, 16):
                part = batch.slice(i, 16).to_pydict()
                blocks = [(b, np.frombuffer(c, "<u2"), n) for b, c, n in zip(part["bits"], part["checkpoints"], part["total"], strict=True)]
                ids = np.concatenate(code.decode(blocks)).astype("<u4")
                docs = np.frombuffer(b"".join(part["doc_ids"]), "<i8")
                per = [np.frombuffer(b, "<i4") for b in part["n_tokens"]]
                start = np.concatenate([f + np.cumsum(n, dtype=np.int64) - n for f, n in zip(part["first"], per, strict=True)])
                n = np.concatenate(per)
                cuts = np.concatenate([[0], np.cumsum(n * 4, dtype=np.int64)]).astype(np.int32)
                lists = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(start), pa.array(n), lists], ["doc_id", "start", "n_tokens", "ids"])

    shards = spark.read.schema("shard int, base long").parquet(f"{folder}/shards")  # a row for each task that wrote blocks
    blocks = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks").join(F.broadcast(shards), "shard")
    blocks = blocks.select((F.col("base") + F.col("ahead")).alias("first"), "total", "doc_ids", "n_tokens", "checkpoints", "bits")
    rows = blocks.mapInArrow(run, "doc_id long, start long, n_tokens int, ids binary")
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
