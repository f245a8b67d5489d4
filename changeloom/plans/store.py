"""A persistent, transactional store of one changelog table, as Parquet files and a manifest.

Layout under the root (any file system that Spark reaches):

* `data/`: Parquet files of changelog rows (key, value, is_delete, seq), sorted by key, immutable;
* `manifest-NNNNNN.json`: all files of one version with level, key range, records, bytes and versions;
* `CURRENT`: the number and checksum of the manifest that counts; replacing it is the commit point.

Every commit has one version number (seq) for all of its rows, at most one row for a key. Data are
written first, then the manifest, then CURRENT, so a reader or a crash sees whole commits only; readers
keep the files of the version they opened until `vacuum`. Data are written and checks are made before a
writer takes the lock file, which it holds for as long as it takes to publish; checks that a commit of
another writer has overtaken are made again. A lock ends by itself, so a writer that died stops no other
for longer than `lease_seconds`; one that lost its lock finds out before it publishes. A transaction's
reads are validated against commits since its snapshot. Level -1 holds unflushed commits, level 0
flushed runs, deeper levels compacted runs with disjoint ranges; flushes and compactions run beside the
writers, and give up if what they read has been replaced meanwhile.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import RESERVED_KEYS
from ..operators import runs as run_ops
from ..operators import state as state_ops
from ..sources.codec import Op, decode_command

SCHEMA = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType()), T.StructField("is_delete", T.BooleanType(), False), T.StructField("seq", T.LongType(), False)])
TAIL = -1


@dataclass(frozen=True)
class Options:
    """Policies. Sizes are bytes of records; None turns a policy off."""

    flush_keys: int | None = 100_000  #: unflushed records that start a flush
    flush_bytes: int | None = 64 << 20
    flush_files: int | None = 64  #: single commits are small files, so their number starts a flush too
    file_bytes: int = 128 << 20  #: aimed size of a run's file
    level_bytes: int = 1 << 30  #: bytes of a level that start its compaction
    l0_runs: int = run_ops.L0_TRIGGER
    compaction: bool = True
    background: bool = True  #: maintenance in a thread of its own; else before the commit returns
    lock_seconds: float = 60.0  #: how long a writer waits for the lock
    lease_seconds: float = 20.0  #: how long a lock counts; it is held for a few file operations
    staging_seconds: float = 24 * 3600.0  #: how long vacuum spares data that a writer has not published yet


@dataclass(frozen=True)
class File:
    segment_id: int
    level: int
    path: str
    min_key: bytes
    max_key: bytes
    n_records: int
    bytes: int
    min_seq: int
    max_seq: int
    seq: int | None = None  #: the rows' version if it is another than the file says: a commit was overtaken while it was written


@dataclass(frozen=True)
class Version:
    number: int = 0
    last_seq: int = 0
    next_segment: int = 1
    files: tuple[File, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)  #: last applied batch of each stream

    def to_json(self) -> str:
        files = [{**f.__dict__, "min_key": f.min_key.hex(), "max_key": f.max_key.hex()} for f in self.files]
        return json.dumps({**self.__dict__, "files": files})

    @staticmethod
    def from_json(text: str) -> Version:
        raw = json.loads(text)
        files = tuple(File(**{**f, "min_key": bytes.fromhex(f["min_key"]), "max_key": bytes.fromhex(f["max_key"])}) for f in raw.pop("files"))
        return Version(files=files, **raw)


class Conflict(RuntimeError):
    """A key that the transaction read was written by a later commit."""


class Closed(RuntimeError):
    pass


class _LostLock(RuntimeError):
    """The lock's time was over before the version was published."""


class _Folder:
    """Small driver-side files through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _local(self, name: str) -> str | None:
        """The path on this machine's file system, if the store is there: Hadoop's own local one neither creates nor replaces files in one step."""
        uri = self.fs.makeQualified(self.path(name)).toUri()
        return uri.getPath() if uri.getScheme() == "file" else None

    def read(self, name: str) -> bytes | None:
        """None without the file."""
        try:
            if (local := self._local(name)) is not None:
                with open(local, "rb") as f:
                    return f.read()
            stream = self.fs.open(self.path(name))
            try:
                return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
        except FileNotFoundError:
            return None
        except Exception as e:  # noqa: BLE001  py4j wraps the file system's own error
            if "FileNotFound" not in str(e):
                raise
            return None

    def write(self, name: str, data: bytes, overwrite: bool = True) -> None:
        if (local := self._local(name)) is not None:
            os.makedirs(os.path.dirname(local), exist_ok=True)
            with open(local, "wb" if overwrite else "xb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            return
        out = self.fs.create(self.path(name), overwrite)
        out.write(bytearray(data))
        out.hsync()
        out.close()

    def create_new(self, name: str, data: bytes) -> bool:
        """False if the file exists."""
        try:
            self.write(name, data, overwrite=False)
        except FileExistsError:
            return False
        except Exception as e:  # noqa: BLE001  py4j wraps the file system's own error
            if "AlreadyExists" not in str(e):
                raise
            return False
        return True

    def swap(self, temp: str, name: str) -> None:
        """Renames over an existing file in one step."""
        if (local := self._local(name)) is not None:
            return os.replace(self._local(temp), local)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri())
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        kinds[0] = rename.OVERWRITE
        context.rename(self.fs.makeQualified(self.path(temp)), self.fs.makeQualified(self.path(name)), kinds)

    def list(self, name: str = "") -> list[str]:
        if not self.fs.exists(self.path(name)):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(name))]

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def rename(self, name: str, to: str) -> bool:
        """False if there is no such file any more."""
        try:
            return self.fs.rename(self.path(name), self.path(to))
        except Exception as e:  # noqa: BLE001  py4j wraps the file system's own error
            if "FileNotFound" not in str(e):
                raise
            return False

    def age(self, name: str) -> float:
        """Seconds since the file was written, 0 without it."""
        found = self.fs.globStatus(self.path(name)) or []
        return max(0.0, time.time() - found[0].getModificationTime() / 1000) if len(found) else 0.0


def _lock_of(raw: bytes | None) -> tuple[str, float] | None:
    """(owner, when its time is over) of a lock file; None if there is none or it is not whole."""
    try:
        owner, until = json.loads(raw or b"")
        return owner, float(until)
    except (ValueError, TypeError):
        return None


class Store:
    """Open with `Store(spark, root)`; a root without a store becomes an empty one."""

    def __init__(self, spark: SparkSession, root: str, options: Options | None = None):
        self.spark, self.options, self.folder = spark, options or Options(), _Folder(spark, root)
        self._closed = False
        self._keeper: threading.Thread | None = None
        self._keeper_error: Exception | None = None
        self._keeping = threading.Lock()
        if self.folder.read("CURRENT") is None:
            with self._lock() as owner:
                if self.folder.read("CURRENT") is None:
                    self._publish(Version(), owner)
        self.current()

    # --- versions

    def current(self) -> Version:
        """The version that CURRENT names; a damaged pointer or manifest is an error, never an empty store. Looked for again if it is replaced at this moment."""
        for _ in range(3):
            try:
                return self._named()
            except ValueError:
                time.sleep(0.05)
        return self._named()

    def _named(self) -> Version:
        if self._closed:
            raise Closed("the store is closed")
        raw = self.folder.read("CURRENT")
        try:
            number, crc = (int(x) for x in raw.decode().split())
        except (AttributeError, ValueError) as e:
            raise ValueError("damaged CURRENT") from e
        text = self.folder.read(f"manifest-{number:06d}.json")
        if text is None or zlib.crc32(text) != crc:
            raise ValueError(f"damaged manifest {number}")
        return Version.from_json(text.decode())

    def _publish(self, version: Version, owner: str) -> Version:
        """Makes a version the current one; the number goes on past manifests that a dead writer left."""
        while not self.folder.create_new(f"manifest-{version.number:06d}.json", (text := version.to_json().encode())):
            version = replace(version, number=version.number + 1)
        temp = f"CURRENT.{uuid.uuid4().hex}"
        self.folder.write(temp, f"{version.number} {zlib.crc32(text)}".encode())
        if not self._owns(owner):
            self.folder.delete(temp)
            self.folder.delete(f"manifest-{version.number:06d}.json")
            raise _LostLock
        self.folder.swap(temp, "CURRENT")
        return version

    def _owns(self, owner: str) -> bool:
        raw = self.folder.read("LOCK")
        held = _lock_of(raw)
        return held is not None and held[0] == owner and held[1] > time.time()

    def _end_stale_lock(self) -> None:
        """Takes away a lock whose time is over: renamed first, as that succeeds for one only, and put back if it was another's by then."""
        raw = self.folder.read("LOCK")
        if raw is None:
            return
        held = _lock_of(raw)
        if held[1] > time.time() if held else self.folder.age("LOCK") <= self.options.lease_seconds:
            return
        dead = f"LOCK.{uuid.uuid4().hex}"
        if self.folder.rename("LOCK", dead):
            taken = self.folder.read(dead)
            if taken != raw and taken:
                self.folder.create_new("LOCK", taken)
            self.folder.delete(dead)

    @contextmanager
    def _lock(self) -> Iterator[str]:
        """One publisher at a time, by exclusive creation of a lock file."""
        owner, end = uuid.uuid4().hex, time.monotonic() + self.options.lock_seconds
        while not self.folder.create_new("LOCK", json.dumps([owner, time.time() + self.options.lease_seconds]).encode()):
            self._end_stale_lock()
            if time.monotonic() > end:
                raise TimeoutError("another writer holds the store's lock")
            time.sleep(0.02)
        try:
            yield owner
        finally:
            if self._owns(owner):
                self.folder.delete("LOCK")

    def _change(self, make: Callable[[Version], Version | None], check: Callable[[Version], None] | None = None) -> Version:
        """Publishes make(current version), or nothing if that is None; `check`, which may run jobs, has passed on the very version that is replaced."""
        while True:
            seen = self.current()
            if check:
                check(seen)
            try:
                with self._lock() as owner:
                    version = self.current()
                    if check and version.number != seen.number:
                        continue
                    new = make(version)
                    return version if new is None else self._publish(new, owner)
            except _LostLock:
                continue

    # --- reading

    def log(self, version: Version | None = None, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """Changelog rows of a version in [low, high). Files outside the range are not read; within files, row groups are skipped by their statistics."""
        version = version or self.current()
        files = [f for f in version.files if (low is None or f.max_key >= low) and (high is None or f.min_key < high)]
        if not files:
            return self.spark.createDataFrame([], SCHEMA)
        parts = []
        for seq in sorted({f.seq or 0 for f in files}):  # 0: as the files say, which nearly all do
            rows = state_ops.in_range(self.spark.read.schema(SCHEMA).parquet(*(f"{self.folder.root}/{f.path}" for f in files if (f.seq or 0) == seq)), low, high)
            parts.append(rows.withColumn("seq", F.lit(seq).cast("long")) if seq else rows)
        return reduce(DataFrame.unionByName, parts)

    def scan(self, low: bytes | None = None, high: bytes | None = None, version: Version | None = None) -> DataFrame:
        """(key, value, seq) of present keys in [low, high), in key order; None leaves a side open."""
        return state_ops.ordered(state_ops.current_state(self.log(version, low, high)))

    def collect_range(self, low: bytes | None, high: bytes | None) -> list[tuple[bytes, bytes]]:
        return [(bytes(r.key), bytes(r.value)) for r in self.scan(low, high).collect()]

    def iterator(self, low: bytes | None = None, high: bytes | None = None) -> Iterator[tuple[bytes, bytes]]:
        """A cursor in key order that fetches one partition at a time."""
        return ((bytes(r.key), bytes(r.value)) for r in self.scan(low, high).toLocalIterator())

    def visit(self, low: bytes | None, high: bytes | None, fn: Callable[[bytes, bytes], None]) -> int:
        """Calls fn(key, value) on the driver for each present key of [low, high), in order; returns how many there were."""
        n = 0
        for key, value in self.iterator(low, high):
            fn(key, value)
            n += 1
        return n

    def seek(self, target: bytes) -> tuple[bytes, bytes] | None:
        """The first present key >= target, with its value."""
        found = state_ops.lower_bound(self.log(low=target), target).collect()
        return (bytes(found[0].key), bytes(found[0].value)) if found else None

    def get(self, key: bytes, version: Version | None = None) -> bytes | None:
        found = state_ops.current_state(self.log(version, key, key + b"\0")).collect()
        return bytes(found[0].value) if found else None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """State of many keys (key binary) in one plan; the way to look up more than a few."""
        return state_ops.multi_get(self.log(), keys)

    def last_seq(self) -> int:
        return self.current().last_seq

    def next_segment_id(self) -> int:
        return self.current().next_segment

    def manifest(self) -> DataFrame:
        rows = [(f.segment_id, f.level, bytearray(f.min_key), bytearray(f.max_key), f.path, f.n_records, f.bytes) for f in self.current().files]
        return self.spark.createDataFrame(rows, "segment_id long, level int, min_key binary, max_key binary, file_path string, n_records long, bytes long")

    def memtable_size(self) -> int:
        """Distinct keys in unflushed commits."""
        version = self.current()
        return self.log(replace(version, files=tuple(f for f in version.files if f.level == TAIL))).select("key").distinct().count()

    def sparse_index(self, segment_id: int, every: int = 16) -> DataFrame:
        """(segment_id, key, offset) of every `every`-th record of one file; without rows for an unknown one. Computed from the rows, so it can't be damaged or go stale."""
        version = self.current()
        own = self.log(replace(version, files=tuple(f for f in version.files if f.segment_id == segment_id)))
        return run_ops.sparse_index(own.withColumn("segment_id", F.lit(segment_id).cast("long")), every)

    def sparse_index_of_level(self, level: int, every: int = 16) -> DataFrame:
        """(segment_id, key, offset) of every `every`-th record of a level's files, whose ranges are disjoint, taken as one file in key order: offsets and records are counted through. No task has more than one file's rows."""
        version = self.current()
        files = sorted((f for f in version.files if f.level == level), key=lambda f: f.min_key)
        if any(a.max_key >= b.min_key for a, b in zip(files, files[1:], strict=False)):
            raise ValueError(f"files of level {level} overlap; compact them first")
        starts, before, start = [], 0, 0
        for f in files:
            starts.append((f.path.rsplit("/", 1)[-1], f.segment_id, before, start))
            before, start = before + f.n_records, start + f.bytes
        if not files:
            return self.sparse_index(-1, every)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.folder.root}/{f.path}" for f in files)).withColumn("file", F.col("_metadata.file_name"))
        begin = self.spark.createDataFrame(starts, "file string, segment_id long, before long, start long")  # a row per file
        return run_ops.sparse_index_of_files(rows.join(F.broadcast(begin), "file"), every)

    def show(self, n: int = 20) -> None:
        """Prints the first versions of unflushed commits."""
        version = self.current()
        self.log(replace(version, files=tuple(f for f in version.files if f.level == TAIL))).orderBy("seq", "key").show(n)

    # --- writing

    def put(self, key: bytes, value: bytes) -> None:
        self._commit([Op(key, value, False)])

    def delete(self, key: bytes) -> None:
        self._commit([Op(key, None, True)])

    def apply(self, command: bytes) -> None:
        """A replicated put or delete command."""
        self._commit([decode_command(command)])

    def begin(self) -> Transaction:
        return Transaction(self)

    def transact(self, work: Callable[[Transaction], None], attempts: int = 5) -> None:
        """Runs `work` in a transaction, again from the start after a conflict."""
        for left in reversed(range(attempts)):
            txn = self.begin()
            work(txn)
            try:
                return txn.commit()
            except Conflict:
                if not left:
                    raise

    def _commit(self, ops: list[Op], read: dict[bytes, None] | None = None, since: Version | None = None) -> int:
        rows = [(bytearray(o.key), None if o.is_delete else bytearray(o.value or b""), o.is_delete) for o in ops]
        frame = self.spark.createDataFrame(rows, "key binary, value binary, is_delete boolean").coalesce(1)

        def check(version: Version) -> None:
            fresh = tuple(f for f in version.files if f.max_seq > since.last_seq) if since else ()
            if read and fresh:
                touched = self.log(replace(version, files=fresh), min(read), max(read) + b"\0").where(F.col("seq") > since.last_seq)
                keys = self.spark.createDataFrame([(bytearray(k),) for k in read], "key binary")
                if not touched.join(F.broadcast(keys), "key", "left_semi").isEmpty():
                    raise Conflict("a key that was read has changed")

        return self.write(frame, check=check, parts=1)

    def write(self, changes: DataFrame, order: str | None = None, parts: int | None = None, check: Callable[[Version], None] | None = None, batch: tuple[str, int] | None = None) -> int:
        """All rows (key, value, is_delete) as one atomic commit; returns its version number.

        Several rows of one key need `order`, the column whose greatest value wins. `batch` (stream,
        number) makes the commit idempotent: a batch that is already in is skipped.
        """
        rows = changes.select(F.col("key").cast("binary").alias("key"), F.when(~F.col("is_delete"), F.col("value").cast("binary")).alias("value"), "is_delete", *([F.col(order).alias("__order")] if order else []))
        bad = F.col("key").isNull() | F.col("key").isin(*(F.lit(k).cast("binary") for k in RESERVED_KEYS))
        rows = rows.withColumn("key", F.when(bad, F.raise_error(F.lit("invalid key")).cast("binary")).otherwise(F.col("key")))
        rows = state_ops.newest(rows, order=("__order",)).drop("__order") if order else rows
        done = lambda version: bool(batch) and version.batches.get(batch[0], -1) >= batch[1]
        seen = self.current()
        if done(seen):
            return seen.last_seq
        if check:
            check(seen)
        seq = seen.last_seq + 1
        with self._staging() as name:
            files = self._files(rows.withColumn("seq", F.lit(seq)), TAIL, 0, parts, name)
            if not order and sum(f.n_records for f in files) > 1 and parts != 1:
                twice = self.log(replace(seen, files=tuple(files))).groupBy("key").count().where("count > 1")
                if not twice.isEmpty():
                    raise ValueError("several rows of one key in a commit need an order")

            def make(version: Version) -> Version | None:
                if done(version):
                    return None
                now = version.last_seq + 1
                new = [replace(f, segment_id=version.next_segment + k, min_seq=now, max_seq=now, seq=None if now == seq else now) for k, f in enumerate(files)]
                batches = {**version.batches, batch[0]: batch[1]} if batch else version.batches
                return replace(version, number=version.number + 1, last_seq=now, next_segment=version.next_segment + len(new), files=(*version.files, *new), batches=batches)

            version = self._change(make, check)
        self._maintain_soon(version)
        return version.last_seq

    @contextmanager
    def _staging(self) -> Iterator[str]:
        """The name of a folder for data that no version names yet; vacuum spares it while its marker is there."""
        name = uuid.uuid4().hex
        self.folder.write(f"staging/{name}", str(time.time() + self.options.staging_seconds).encode())
        try:
            yield f"data/{name}"
        finally:
            self.folder.delete(f"staging/{name}")

    def _files(self, rows: DataFrame, level: int, first: int, parts: int | None, name: str | None = None) -> list[File]:
        """Writes rows as key-ordered files and describes each from its own rows."""
        name = name or f"data/{uuid.uuid4().hex}"
        if parts is None:
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = rows.repartitionByRange(parts, "key") if parts > 1 else rows.coalesce(1)
        ranged.select("key", "value", "is_delete", "seq").sortWithinPartitions("key").write.parquet(f"{self.folder.root}/{name}")
        size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(13)) + 12
        back = self.spark.read.schema(SCHEMA).parquet(f"{self.folder.root}/{name}").withColumn("file", F.col("_metadata.file_name"))
        stats = back.groupBy("file").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"), F.sum(size).alias("b"), F.min("seq").alias("s0"), F.max("seq").alias("s1")).orderBy("lo").collect()  # a row per file
        return [File(first + k, level, f"{name}/{r.file}", bytes(r.lo), bytes(r.hi), r.n, r.b, r.s0, r.s1) for k, r in enumerate(stats)]

    # --- maintenance

    def _wants_flush(self, version: Version) -> bool:
        tail, o = [f for f in version.files if f.level == TAIL], self.options
        over = lambda most, now: most is not None and now >= most
        return over(o.flush_keys, sum(f.n_records for f in tail)) or over(o.flush_bytes, sum(f.bytes for f in tail)) or over(o.flush_files, len(tail))

    def _wants_work(self, version: Version) -> bool:
        return self._wants_flush(version) or (self.options.compaction and self._due(version) is not None)

    def maintain(self) -> None:
        """Flushes and compacts as long as the policies ask for it; one thread of a store at a time."""
        with self._keeping:
            if self._wants_flush(self.current()):
                self._flush()
            while self.options.compaction and (level := self._due(self.current())) is not None:
                self._compact(level)

    def _maintain_soon(self, version: Version) -> None:
        if not self._wants_flush(version):
            return
        if not self.options.background:
            return self.maintain()
        if self._keeper is None or not self._keeper.is_alive():
            self._keeper = threading.Thread(target=self._keep, name="store-maintenance", daemon=True)
            self._keeper.start()

    def _keep(self) -> None:
        try:
            while not self._closed and self._wants_work(self.current()):
                self.maintain()
        except Closed:
            pass
        except Exception as e:  # noqa: BLE001  the next wait tells
            self._keeper_error = e

    def wait(self) -> None:
        """Until the maintenance that commits have started is over; raises what it failed with."""
        if self._keeper is not None:
            self._keeper.join()
        if self._keeper_error is not None:
            error, self._keeper_error = self._keeper_error, None
            raise error

    def flush(self) -> None:
        """Unflushed commits become a run of level 0: the newest version of each key, deletions kept. No-op without any."""
        with self._keeping:
            self._flush()

    def _parts(self, files: list[File]) -> int:
        return max(1, -(-sum(f.bytes for f in files) // self.options.file_bytes))

    def _flush(self) -> None:
        version = self.current()
        tail = [f for f in version.files if f.level == TAIL]
        if tail:
            self._replace(tail, state_ops.newest(self.log(replace(version, files=tuple(tail)))), 0, lambda now: True)

    def _replace(self, gone: list[File], rows: DataFrame, level: int, holds: Callable[[Version], bool]) -> None:
        """The files `gone` by files of `rows`; nothing if they are not all there any more or what the rows rest on does not hold."""
        with self._staging() as name:
            new = self._files(rows, level, 0, self._parts(gone), name)

            def make(version: Version) -> Version | None:
                if not set(gone) <= set(version.files) or not holds(version):
                    return None
                left = tuple(f for f in version.files if f not in gone)
                numbered = [replace(f, segment_id=version.next_segment + k) for k, f in enumerate(new)]
                return replace(version, number=version.number + 1, next_segment=version.next_segment + len(new), files=(*left, *numbered))

            self._change(make)

    def _due(self, version: Version) -> int | None:
        """The lowest level that needs a compaction."""
        for level in sorted({f.level for f in version.files if f.level >= 0}):
            own = [f for f in version.files if f.level == level]
            runs = len({f.path.split("/")[1] for f in own})
            if (level == 0 and runs >= self.options.l0_runs) or sum(f.bytes for f in own) >= self.options.level_bytes * 10 ** max(0, level - 1):
                return level
        return None

    def compact(self, level: int = 0) -> None:
        with self._keeping:
            self._compact(level)

    def _compact(self, level: int) -> None:
        """Level 0, or the first file of a deeper one, merged with what it overlaps in the next level."""
        version = self.current()
        base = sorted((f for f in version.files if f.level == level), key=lambda f: (f.min_key, f.segment_id))
        base = base if level == 0 else base[:1]
        if not base:
            return
        lo, hi = min(f.min_key for f in base), max(f.max_key for f in base)
        meets = lambda f: f.max_key >= lo and f.min_key <= hi
        inputs = base + [f for f in version.files if f.level == level + 1 and meets(f)]
        below = lambda v: {f for f in v.files if f.level > level and f not in inputs and meets(f)}
        bottom = not below(version)
        rows = run_ops.compact(self.log(replace(version, files=tuple(inputs))), bottom)
        # no new file of the next level overlaps, and what was the bottom still is
        self._replace(inputs, rows, level + 1, lambda now: {f for f in below(now) if f.level == level + 1} == set() and not (bottom and below(now)))

    def vacuum(self) -> int:
        """Deletes data, manifests and markers that neither the current version nor a writer at work needs; readers of older versions must be done."""
        # in this order nothing of a commit under way is taken for old: it is marked before it is written, and unmarked after it is published
        data, manifests = self.folder.list("data"), [n for n in self.folder.list() if n.startswith("manifest-")]
        marks = {n: float(self.folder.read(f"staging/{n}") or b"0") for n in self.folder.list("staging")}
        version = self.current()
        live = {n for n, until in marks.items() if until > time.time()}
        keep = {f.path.split("/")[1] for f in version.files} | live
        old = [f"data/{d}" for d in data if d not in keep] + [f"staging/{n}" for n in marks if n not in live]
        old += [n for n in manifests if int(n[len("manifest-") :].split(".")[0]) < version.number or (not live and n != f"manifest-{version.number:06d}.json" and self.folder.age(n) > self.options.lease_seconds)]
        for name in old:
            self.folder.delete(name)
        return len(old)

    # --- snapshots and streams

    def snapshot(self, path: str) -> int:
        """The complete state as a store of its own at `path`; returns the version number it is of."""
        version = self.current()
        rows = state_ops.current_state(self.log(version)).withColumn("is_delete", F.lit(False))
        other = Store(self.spark, path, self.options)
        if other.current().files:
            raise ValueError("a snapshot needs an empty folder")
        with other._staging() as name:
            files = other._files(rows, 1, 1, other._parts(list(version.files)), name)
            other._change(lambda now: None if now.files else Version(now.number + 1, version.last_seq, 1 + len(files), tuple(files), version.batches))
        return version.last_seq

    def restore(self, path: str) -> None:
        """Replaces this store's state by a snapshot's; its version numbers go on from the greater of both."""
        source = Store(self.spark, path, self.options)
        theirs = source.current()
        with self._staging() as name:
            files = self._files(source.log(theirs), 1, 0, self._parts(list(theirs.files)), name)

            def make(version: Version) -> Version:
                mine = tuple(replace(f, segment_id=version.next_segment + k) for k, f in enumerate(files))
                return Version(version.number + 1, max(version.last_seq, theirs.last_seq), version.next_segment + len(files), mine, theirs.batches)

            self._change(make)

    def ingest(self, changes: DataFrame, checkpoint: str, name: str, order: str = "seq", trigger: dict | None = None):
        """Applies a streaming changelog (key, value, is_delete, `order`) batch by batch; each batch is one commit and counts once, also after a restart."""

        def apply(frame: DataFrame, number: int) -> None:
            self.write(frame, order=order, batch=(name, number))

        return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def clear(self) -> None:
        """An empty state under the next version; versions go on."""
        self._change(lambda version: replace(version, number=version.number + 1, files=()))

    def close(self) -> None:
        """No more reads and writes; maintenance under way ends with its present step."""
        self._closed = True
        if self._keeper is not None and self._keeper is not threading.current_thread():
            self._keeper.join()

    def destroy(self) -> None:
        """Closes the store and deletes all of its files."""
        self.close()
        self.folder.delete("")


class Transaction:
    """Buffered writes over one version of the store; all of them are published at once, or none."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.current()
        self._writes: dict[bytes, Op] = {}
        self._read: dict[bytes, None] = {}
        self._over = False

    def _buffer(self, op: Op) -> None:
        if self._over:
            raise RuntimeError("the transaction is over")
        if op.key is None or op.key in {k.encode() for k in RESERVED_KEYS}:
            raise ValueError("invalid key")
        self._writes[op.key] = op

    def put(self, key: bytes, value: bytes) -> None:
        self._buffer(Op(key, value, False))

    def delete(self, key: bytes) -> None:
        self._buffer(Op(key, None, True))

    def get(self, key: bytes) -> bytes | None:
        """The own write if there is one, else the store's value when the transaction began; a commit of writes fails if another one has written the key since."""
        if key in self._writes:
            return self._writes[key].value
        self._read[key] = None
        return self.store.get(key, self.base)

    def get_for_update(self, key: bytes) -> bytes | None:
        """As `get`, and the key counts as read even if the own write answers."""
        self._read[key] = None
        return self.get(key)

    def scan(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        rows = [(bytearray(o.key), None if o.is_delete else bytearray(o.value or b""), o.is_delete) for o in self._writes.values()]
        buffer = state_ops.in_range(self.store.spark.createDataFrame(rows, "key binary, value binary, is_delete boolean"), low, high)
        return state_ops.overlay(state_ops.current_state(self.store.log(self.base, low, high)), buffer).orderBy("key")

    def commit(self) -> None:
        if self._over:
            raise RuntimeError("the transaction is over")
        self._over = True
        if self._writes:
            self.store._commit(list(self._writes.values()), self._read, self.base)

    def rollback(self) -> None:
        self._over = True
        self._writes.clear()
