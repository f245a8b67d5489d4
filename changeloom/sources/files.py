"""Reads and writes the binary log, segment, index and manifest files as DataFrames.

Files are read with Spark's `binaryFile` source, so any store that Spark reaches will do; each file is
decoded by one task with its checksums verified. A log may end in a torn record, which `read_wal`
reports as a row with checksum_ok = false (`operators.log.readable` then applies the recovery rule);
everywhere else damage is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import number_of
from . import codec

_OPS = "array<struct<key: binary, value: binary, is_delete: boolean>>"


#: So many rows leave a worker at a time.
FRAME_ROWS = 10_000


def in_frames(rows: Iterable[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of at most FRAME_ROWS rows each."""
    rows = iter(rows)
    while found := list(islice(rows, FRAME_ROWS)):
        yield pd.DataFrame(found, columns=names)


def bound_files(files: DataFrame) -> DataFrame:
    """files (with a column `content`), in a session whose Arrow batches hold at most 4 MB, or one file: 10,000 files would be a batch else, whatever their size.

    Plans run when the caller uses them, so the setting stays; a smaller one of the caller's is kept.
    """
    key, most, conf = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20, files.sparkSession.conf
    now = conf.get(key, str(1 << 30))
    if not (now.isdigit() and 0 < int(now) <= most):
        conf.set(key, str(most))
    return files


def _decode(spark: SparkSession, folder: str, kind: str, rows, schema: str) -> DataFrame:
    """A row for each record of the files `kind`-NNNNNN of a folder; rows(file number, data) yields tuples."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, data in zip(frame["number"], frame["content"], strict=True):
                yield from in_frames(rows(int(number), bytes(data)), names)

    names = [c.strip().split(" ")[0].rstrip(":") for c in _columns(schema)]
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{kind}-*").load(folder)
    files = files.select(number_of(F.col("path"), kind).alias("number"), "content").where("number is not null")
    return bound_files(files).mapInPandas(run, schema)


def _columns(schema: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word)
            word = ""
        else:
            word += c
    return [*out, word]


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    def rows(number, data):
        for offset, crc, op in codec.decode_segment(data):
            yield number, offset, crc, op.key, op.value, op.is_delete

    return _decode(spark, folder, "segment", rows, "segment_id long, offset long, checksum long, key binary, value binary, is_delete boolean")


def read_wal(spark: SparkSession, folder: str) -> DataFrame:
    """(wal_id, seq, term, record_type, ops, checksum, checksum_ok): each record, and one row for the damaged end of a file."""

    def rows(number, data):
        seq = -1
        try:
            for _, r in codec.decode_wal(data):
                seq = r.seq
                ops = [{"key": o.key, "value": o.value, "is_delete": o.is_delete} for o in codec.wal_ops(r)]
                yield number, r.seq, r.term, r.record_type, ops, r.checksum, True
        except codec.Torn:
            yield number, seq + 1, None, None, None, None, False

    return _decode(spark, folder, "wal", rows, f"wal_id long, seq long, term long, record_type int, ops {_OPS}, checksum long, checksum_ok boolean")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse-index entries (segment_id, key, offset); a damaged index is an error, to be rebuilt by `operators.runs.sparse_index`."""

    def rows(_, data):
        for _, e in codec.decode_index(data):
            yield e.segment_id, e.key, e.offset

    return _decode(spark, folder, "index", rows, "segment_id long, key binary, offset long")


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    def rows(number, data):
        for _, e in codec.decode_manifest(data):
            yield number, e.segment_id, e.level, e.min_key, e.max_key, e.file_path

    return _decode(spark, folder, "MANIFEST", rows, "manifest_id long, segment_id long, level int, min_key binary, max_key binary, file_path string")


def read_pointer(spark: SparkSession, folder: str) -> str | None:
    """The manifest that CURRENT names; None without the file, an error if it is damaged."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "CURRENT").load(folder).select("content").collect()
    return codec.decode_pointer(bytes(found[0][0])) if found else None


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a file through Hadoop's file systems: to a temporary name, then renamed into place."""
    jvm = spark.sparkContext._jvm
    target, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(temp, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(target, False)
    if not fs.rename(temp, target):
        raise OSError(f"cannot rename {path}.tmp")


def write_files(files: DataFrame, folder: str) -> int:
    """Writes files (name string, content binary) into a folder that all executors reach, each by one task: to a temporary name, then moved into place. Returns how many there were.

    A task that runs again writes the same bytes under the same name.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:", "file://", 1))
        system.create_dir(root, recursive=True)
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                temp = f"{root}/_{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(temp) as out:
                    out.write(bytes(content))
                system.move(temp, f"{root}/{name}")
            yield pd.DataFrame({"n": [len(frame)]})

    return bound_files(files).select("name", "content").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def segment_files(runs: DataFrame) -> DataFrame:
    """Runs (segment_id, key, value, is_delete) as files (name, content): records in key order. A run is bounded by the size it is split at, and one task holds one."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        ops = [codec.Op(bytes(k), None if d else bytes(v or b""), bool(d)) for k, v, d in zip(frame["key"], frame["value"], frame["is_delete"], strict=True)]
        return pd.DataFrame({"name": [f"segment-{int(frame['segment_id'].iloc[0]):06d}"], "content": [codec.encode_segment(ops)]})

    rows = runs.select("segment_id", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "is_delete")
    return rows.groupBy("segment_id").applyInPandas(run, "name string, content binary")


def wal_files(commits: DataFrame) -> DataFrame:
    """Commit records (wal_id, seq, ops: array of key, value, is_delete, ...) as log files (name, content), each in the order of seq; a log file is bounded by the size at which the log rolls."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame, out = frame.sort_values("seq"), []
        for seq, ops in zip(frame["seq"], frame["ops"], strict=True):
            found = [codec.Op(bytes(o["key"]), None if o["is_delete"] else bytes(o["value"] or b""), bool(o["is_delete"])) for o in ops]
            out.append(codec.encode_wal(int(seq), codec.COMMIT, codec.commit_payload(found)))
        return pd.DataFrame({"name": [f"wal-{int(frame['wal_id'].iloc[0]):06d}"], "content": [b"".join(out)]})

    ops = F.transform("ops", lambda o: F.struct(o["key"].cast("binary").alias("key"), o["value"].cast("binary").alias("value"), o["is_delete"].alias("is_delete")))
    return commits.select("wal_id", "seq", ops.alias("ops")).groupBy("wal_id").applyInPandas(run, "name string, content binary")


def index_files(index: DataFrame) -> DataFrame:
    """Sparse-index entries (segment_id, key, offset) as files (name, content), one for each run."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        entries = [codec.IndexEntry(int(s), bytes(k), int(o)) for s, k, o in zip(frame["segment_id"], frame["key"], frame["offset"], strict=True)]
        return pd.DataFrame({"name": [f"index-{entries[0].segment_id:06d}"], "content": [codec.encode_index(entries)]})

    return index.select("segment_id", F.col("key").cast("binary").alias("key"), "offset").groupBy("segment_id").applyInPandas(run, "name string, content binary")


def manifest_file(manifest: DataFrame, number: int) -> DataFrame:
    """A manifest (segment_id, level, min_key, max_key, file_path; a row for each run) as one file (name, content)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["level", "segment_id"])
        entries = [codec.SegmentMeta(int(s), int(v), bytes(a), bytes(b), p) for s, v, a, b, p in zip(*(frame[c] for c in ("segment_id", "level", "min_key", "max_key", "file_path")), strict=True)]
        return pd.DataFrame({"name": [f"MANIFEST-{number:06d}"], "content": [codec.encode_manifest(entries)]})

    rows = manifest.select("segment_id", "level", F.col("min_key").cast("binary").alias("min_key"), F.col("max_key").cast("binary").alias("max_key"), "file_path")
    return rows.groupBy(F.lit(number).alias("number")).applyInPandas(run, "name string, content binary")


def list_files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(number, name, pos) of the files `kind`-NNNNNN of a folder, oldest first; a row for each file."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{kind}-*").load(folder).select("path")
    named = files.select(number_of(F.col("path"), kind).alias("number"), F.regexp_extract("path", "([^/]+)$", 1).alias("name")).where("number is not null")
    return named.withColumn("pos", F.row_number().over(Window.orderBy("number")).cast("long"))


def export_segment(rows: DataFrame, path: str, limit_bytes: int = 64 << 20) -> None:
    """One run (key, value, is_delete), sorted, as a segment file; runs are size-bounded, which is checked."""
    from .codec import Op

    size = rows.agg(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(13)) + 12)).first()[0] or 0
    if size > limit_bytes:
        raise ValueError(f"a run of {size} bytes is over {limit_bytes}; split it first")
    ops = [Op(bytes(r["key"]), None if r["value"] is None else bytes(r["value"]), r["is_delete"]) for r in rows.select(F.col("key").cast("binary"), F.col("value").cast("binary"), "is_delete").orderBy("key").collect()]
    write_bytes(rows.sparkSession, path, codec.encode_segment(ops))
