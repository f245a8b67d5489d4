"""Registered queries over the binary formats and the persistent store, with the SQL that each equals; they add to the catalog.

Files and stores are made in folders of their own below the shared one, from the whole changelog.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .catalog import SEGMENT, changelog, crc_sql, le_sql, query
from .functions import records
from .operators import log as logs
from .operators import runs, state
from .plans.store import Conflict, Options, Store
from .sources import codec, files

#: Nothing happens by itself: each query asks for the step that it is about.
STEPS = Options(flush_keys=None, flush_bytes=None, flush_files=None, compaction=False, file_bytes=1 << 20)


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{known.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _text(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) if c in names else F.col(c) for c in df.columns))


def _mapped(df: DataFrame, rows: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """rows(each row's values) yields tuples of the new columns, which leave a bounded number at a time."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from files.in_frames((r for frame in frames for row in frame.itertuples(index=False) for r in rows(*row)), names)

    return files.bound_files(df).mapInPandas(run, schema)


def _runs(spark, sf_dir) -> DataFrame:
    return runs.flush(changelog(spark, sf_dir)).select("segment_id", "key", "value", "is_delete", "seq")


# --- files


@query("""SELECT segment_id, CAST(coalesce(sum(size) OVER (PARTITION BY segment_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", key, value, is_delete FROM sized""")
def segment_file_scan(spark, sf_dir):
    """Each run written as a segment file, and all of them read back."""
    folder = _folder(spark, "segments")
    files.write_files(files.segment_files(_runs(spark, sf_dir)), folder)
    return _text(files.read_segments(spark, folder), "key", "value").drop("checksum")


@query("SELECT segment_id AS number, 'segment-' || lpad(CAST(segment_id AS VARCHAR), 6, '0') AS name, row_number() OVER (ORDER BY segment_id) AS pos FROM (SELECT DISTINCT segment_id FROM log)")
def segment_file_list(spark, sf_dir):
    folder = _folder(spark, "segments")
    files.write_files(files.segment_files(_runs(spark, sf_dir)), folder)
    return files.list_files(spark, folder, "segment")


_RECORD = f"{le_sql('strlen(key)', 4)} || {le_sql('strlen(value)', 4)} || hex(encode(key)) || hex(encode(value))"


@query(f"SELECT * FROM {crc_sql('state', _RECORD, 'key, value', 'checksum')}")
def segment_bytes_decode(spark, sf_dir):
    """Records made by SQL functions, decoded by the codec, which checks what they carry."""
    blobs = catalog.latest_state(spark, sf_dir).select(records.record_bytes(F.col("key"), F.col("value")).alias("data"))
    return _mapped(blobs, lambda data: ((o.key.decode(), o.value.decode(), crc) for _, crc, o in codec.decode_segment(bytes(data))), "key string, value string, checksum long")


def _commits(spark, sf_dir) -> DataFrame:
    batches = logs.commit_batches(changelog(spark, sf_dir).select("txn_id", "key", "value", "is_delete", "seq"))
    return batches.withColumn("wal_id", F.floor(F.col("seq") / SEGMENT))


def _ops(wal: DataFrame) -> DataFrame:
    return _text(wal.select("wal_id", "seq", F.explode("ops").alias("op")).select("wal_id", "seq", "op.key", "op.value", "op.is_delete"), "key", "value")


_LAST_OPS = "SELECT segment_id AS wal_id, CAST(max(seq) OVER (PARTITION BY txn_id) AS BIGINT) AS seq, key, value, is_delete, txn_id FROM log QUALIFY row_number() OVER (PARTITION BY txn_id, key ORDER BY log.seq DESC) = 1"


@query(f", ops AS ({_LAST_OPS}) SELECT wal_id, seq, key, value, is_delete FROM ops")
def wal_file_scan(spark, sf_dir):
    """Transactions as commit records of log files, read back and taken apart."""
    folder = _folder(spark, "wal")
    files.write_files(files.wal_files(_commits(spark, sf_dir)), folder)
    return _ops(files.read_wal(spark, folder).where("checksum_ok"))


@query(f", ops AS ({_LAST_OPS}) SELECT wal_id, seq, key, value, is_delete FROM ops WHERE txn_id < (SELECT max(txn_id) FROM log)")
def wal_file_torn(spark, sf_dir):
    """The last file lacks its last bytes, as after a crash: recovery ends before its last record."""
    folder = _folder(spark, "wal")
    whole = files.wal_files(_commits(spark, sf_dir))
    last = whole.agg(F.max("name").alias("last"))  # one row
    cut = F.when(F.col("name") == F.col("last"), F.expr("substring(content, 1, octet_length(content) - 7)")).otherwise(F.col("content"))
    files.write_files(whole.crossJoin(F.broadcast(last)).select("name", cut.alias("content")), folder)
    return _ops(logs.readable(files.read_wal(spark, folder)))


@query("SELECT segment_id AS number, 'wal-' || lpad(CAST(segment_id AS VARCHAR), 6, '0') AS name, row_number() OVER (ORDER BY segment_id) AS pos FROM (SELECT DISTINCT segment_id FROM log)")
def wal_file_list(spark, sf_dir):
    folder = _folder(spark, "wal")
    files.write_files(files.wal_files(_commits(spark, sf_dir)), folder)
    return files.list_files(spark, folder, "wal")


_LEGACY = f"{le_sql('seq', 8)} || {le_sql('strlen(key)', 4)} || {le_sql('strlen(value)', 4)} || hex(encode(key)) || hex(encode(value))"


@query(f"SELECT * FROM {crc_sql('state', _LEGACY, 'seq, key, value', 'checksum')}")
def legacy_log_decode(spark, sf_dir):
    rows = catalog.latest_state(spark, sf_dir).select("seq", "key", "value")
    blobs = _mapped(rows, lambda seq, key, value: [(codec.encode_legacy(int(seq), key.encode(), value.encode()),)], "data binary")
    decoded = lambda r: [(r.seq, r.key.decode(), r.value.decode(), r.checksum)]
    return _mapped(blobs, lambda data: decoded(codec.decode_legacy(bytes(data))), "seq long, key string, value string, checksum long")


@query("SELECT * FROM idx")
def index_file_scan(spark, sf_dir):
    folder = _folder(spark, "index")
    files.write_files(files.index_files(catalog.sparse_index(spark, sf_dir)), folder)
    return _text(files.read_index(spark, folder), "key")


_PATH = "'segment-' || lpad(CAST(segment_id AS VARCHAR), 6, '0')"


def _manifest_folder(spark, sf_dir) -> str:
    folder = _folder(spark, "manifest")
    rows = catalog.segment_manifest(spark, sf_dir).withColumn("file_path", records.file_name("segment", F.col("segment_id")))
    files.write_files(files.manifest_file(rows, 7), folder)
    return folder


@query(f"SELECT CAST(7 AS BIGINT) AS manifest_id, segment_id, level, min_key, max_key, {_PATH} AS file_path FROM man")
def manifest_file_scan(spark, sf_dir):
    return _text(files.read_manifests(spark, _manifest_folder(spark, sf_dir)), "min_key", "max_key")


@query("SELECT 'MANIFEST-000007' AS path, count(*) AS n_segments FROM man")
def pointer_file_read(spark, sf_dir):
    """The manifest that the pointer file names, and what it holds."""
    folder = _manifest_folder(spark, sf_dir)
    files.write_bytes(spark, f"{folder}/CURRENT", codec.encode_pointer("MANIFEST-000007"))
    path = files.read_pointer(spark, folder)
    found = files.read_manifests(spark, folder).where(records.file_name("MANIFEST", F.col("manifest_id")) == path)
    return found.agg(F.lit(path).alias("path"), F.count("*").alias("n_segments"))


@query(f"SELECT segment_id, kind, path, key, value, is_delete FROM run, (SELECT CAST({codec.BLOCK_MEMTABLE} AS INTEGER) AS kind, '' AS prefix UNION ALL SELECT {codec.BLOCK_SEGMENT}, 'segment-') k, "
       "LATERAL (SELECT CASE WHEN prefix <> '' THEN prefix || lpad(CAST(segment_id AS VARCHAR), 6, '0') END AS path) p")  # fmt: skip
def snapshot_blocks(spark, sf_dir):
    """Each run as a block of unflushed records and as a block with a file, taken apart again."""

    def blocks(name: str, content: bytes) -> Iterator[tuple]:
        number, data = int(name.split("-")[1]), bytes(content)
        ops = [o for _, _, o in codec.decode_segment(data)]
        for kind, path, body in codec.decode_blocks(codec.encode_memtable_block(ops) + codec.encode_file_block(codec.BLOCK_SEGMENT, name, data)):
            for _, _, o in codec.decode_segment(body):
                yield number, kind, path, o.key.decode(), None if o.is_delete else o.value.decode(), o.is_delete

    return _mapped(files.segment_files(_runs(spark, sf_dir)), blocks, "segment_id long, kind int, path string, key string, value string, is_delete boolean")


@query("SELECT seq, key, value, is_delete FROM log")
def command_round_trip(spark, sf_dir):
    """Each change as a command of the replicated log, and back."""

    def there_and_back(seq, key, value, is_delete) -> Iterator[tuple]:
        op = codec.decode_command(codec.encode_command(codec.Op(key.encode(), None if is_delete else value.encode(), bool(is_delete))))
        yield seq, op.key.decode(), None if op.is_delete else op.value.decode(), op.is_delete

    rows = changelog(spark, sf_dir).select("seq", "key", "value", "is_delete")
    return _mapped(rows, there_and_back, "seq long, key string, value string, is_delete boolean")


@query("SELECT DISTINCT segment_id AS number, 'wal-' || lpad(CAST(segment_id AS VARCHAR), 6, '0') AS name, segment_id AS parsed, CAST(NULL AS BIGINT) AS other FROM log")
def file_names(spark, sf_dir):
    """Names from numbers and numbers from names; a name of another kind has none."""
    ids = changelog(spark, sf_dir).select(F.col("segment_id").alias("number")).distinct()
    name = records.file_name("wal", F.col("number"))
    return ids.select("number", name.alias("name"), records.number_of(F.concat(F.lit("/data/"), name), "wal").alias("parsed"), records.number_of(name, "segment").alias("other"))


@query(f"SELECT DISTINCT seq, {le_sql('seq * 2654435761', 4)} AS bytes4, (seq * 2654435761) % 4294967296 AS back4, {le_sql('seq * 2654435761', 7)} AS bytes7, seq * 2654435761 AS back7 FROM log")
def little_endian_round_trip(spark, sf_dir):
    number = F.col("seq") * F.lit(2654435761)
    four, seven = records.little_endian(number, 4), records.little_endian(number, 7)
    rows = changelog(spark, sf_dir).select("seq", four.alias("four"), seven.alias("seven"))
    return rows.select("seq", F.hex("four").alias("bytes4"), records.from_little_endian(F.col("four"), 4).alias("back4"), F.hex("seven").alias("bytes7"), records.from_little_endian(F.col("seven"), 7).alias("back7"))


# --- the store


def _third(log: DataFrame, k: int) -> DataFrame:
    return log.where(F.pmod(F.floor(F.col("seq") / SEGMENT), F.lit(3)) == k)


def _loaded(spark: SparkSession, sf_dir: str, name: str) -> Store:
    """A store with the whole changelog in one commit."""
    store = Store(spark, _folder(spark, name), STEPS)
    store.write(changelog(spark, sf_dir).select("key", "value", "is_delete", "seq"), order="seq")
    return store


def _state(rows: DataFrame) -> DataFrame:
    return _text(rows.select("key", "value"), "key", "value")


_STATE = "SELECT key, value FROM state"
#: Commits in the order of segment id modulo 3: later ones win, whatever the rows' own numbers.
_COMMITS = "SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY segment_id % 3 DESC, seq DESC) = 1"


@query(f", won AS ({_COMMITS}) SELECT key, value FROM won WHERE NOT is_delete")
def store_scan(spark, sf_dir):
    """Three commits with flushes, compactions into two levels and a vacuum between them, then an ordered scan."""
    store, log = Store(spark, _folder(spark, "store"), STEPS), changelog(spark, sf_dir).select("key", "value", "is_delete", "seq")
    for k in range(3):
        store.write(_third(log, k), order="seq")
        if k:
            store.flush()
        if k == 1:
            store.compact(0)
    store.vacuum()
    return _state(store.scan())


@query(_STATE)
def store_reopen(spark, sf_dir):
    """What a crash leaves behind, data without a manifest and a manifest without a pointer, is no part of the state; nor after the store is opened anew."""
    store = _loaded(spark, sf_dir, "reopen")
    store._files(store.log().withColumn("value", F.lit(b"lost").cast("binary")), -1, 99, 1)
    store.folder.write(f"manifest-{store.current().number + 1:06d}.json", b"{")
    store.close()
    again = Store(spark, store.folder.root, STEPS)
    again.flush()
    again.vacuum()
    return _state(again.scan())


@query(f"SELECT * FROM ({_STATE}) WHERE key NOT IN ('user-1', 'user-2', '') UNION ALL SELECT 'user-1', 'put again' UNION ALL SELECT '', 'empty key'")
def store_puts(spark, sf_dir):
    store = _loaded(spark, sf_dir, "puts")
    store.put(b"user-1", b"put")
    store.put(b"user-1", b"put again")
    store.put(b"user-2", b"put")
    store.delete(b"user-2")
    store.delete(b"never there")
    store.put(b"", b"empty key")
    return _state(store.scan())


@query(f"SELECT * FROM ({_STATE}) WHERE key NOT IN ('user-1', 'user-2', 'user-3', 'n') UNION ALL SELECT 'user-1', 'other' UNION ALL SELECT 'n', '2'")
def store_transactions(spark, sf_dir):
    """One commit, one rollback, one that fails as a key it read has changed, and two counted up with repetition."""
    store = _loaded(spark, sf_dir, "txn")
    first = store.begin()
    first.put(b"user-1", b"first")
    first.delete(b"user-2")
    if first.get(b"user-1") != b"first" or first.get(b"user-2") is not None:
        raise AssertionError("a transaction does not see its own writes")
    first.commit()
    gone = store.begin()
    gone.put(b"user-1", b"rolled back")
    gone.rollback()
    late = store.begin()
    late.get_for_update(b"user-1")
    store.put(b"user-1", b"other")
    late.put(b"user-3", b"must not be seen")
    try:
        late.commit()
    except Conflict:
        store.delete(b"user-3")
    for _ in range(2):
        store.transact(lambda txn: txn.put(b"n", str(int(txn.get(b"n") or b"0") + 1).encode()))
    return _state(store.scan())


@query(f"SELECT * FROM ({_STATE}) WHERE key NOT IN ('user-7', 'user-8') UNION ALL SELECT 'user-7', 'applied'")
def store_commands(spark, sf_dir):
    store = _loaded(spark, sf_dir, "commands")
    for op in (codec.Op(b"user-7", b"applied", False), codec.Op(b"user-8", b"soon gone", False), codec.Op(b"user-8", None, True)):
        store.apply(codec.encode_command(op))
    return _state(store.scan())


@query(_STATE)
def store_snapshot_restore(spark, sf_dir):
    """A snapshot, restored into a store that held something else; the first store goes on and is destroyed."""
    store = _loaded(spark, sf_dir, "snap-from")
    snapshot = _folder(spark, "snap")
    store.snapshot(snapshot)
    store.put(b"user-1", b"after the snapshot")
    other = Store(spark, _folder(spark, "snap-to"), STEPS)
    other.put(b"gone", b"1")
    other.restore(snapshot)
    store.destroy()
    return _state(other.scan())


@query("SELECT 'kept' AS key, '1' AS value")
def store_clear(spark, sf_dir):
    store = _loaded(spark, sf_dir, "clear")
    store.clear()
    store.put(b"kept", b"1")
    return _state(store.scan())


@query("SELECT CAST(0 AS INTEGER) AS level, min(key) AS min_key, max(key) AS max_key, count(*) AS n_records, CAST(sum(12 + strlen(key) + CASE WHEN is_delete THEN 13 ELSE strlen(value) END) AS BIGINT) AS bytes FROM newest")
def store_manifest(spark, sf_dir):
    """The manifest after a flush, by level: the newest version of each key, deletions kept."""
    store = _loaded(spark, sf_dir, "manifest")
    store.flush()
    sums = store.manifest().groupBy("level").agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), F.sum("n_records").alias("n_records"), F.sum("bytes").cast("long").alias("bytes"))
    return _text(sums, "min_key", "max_key")


@query("SELECT CAST(1 AS INTEGER) AS level, min(key) AS min_key, max(key) AS max_key, count(*) AS n_records FROM state")
def store_compaction(spark, sf_dir):
    """Runs of level 0 merged at the bottom by the policy: deletions are gone."""
    options = Options(flush_keys=1, flush_bytes=None, l0_runs=2, background=True)
    store, log = Store(spark, _folder(spark, "compact"), options), changelog(spark, sf_dir).select("key", "value", "is_delete", "seq")
    half = log.agg(F.max("seq")).first()[0] // 2
    store.write(log.where(F.col("seq") <= half), order="seq")
    store.wait()
    store.write(log.where(F.col("seq") > half), order="seq")
    store.wait()
    sums = store.manifest().groupBy("level").agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), F.sum("n_records").alias("n_records"))
    return _text(sums, "min_key", "max_key")


@query("SELECT CAST(4 AS BIGINT) AS last_seq, CAST(0 AS BIGINT) AS unflushed, count(*) AS n_keys FROM state")
def store_positions(spark, sf_dir):
    """Version numbers count commits; a flush changes none and leaves nothing unflushed."""
    store, log = Store(spark, _folder(spark, "positions"), STEPS), changelog(spark, sf_dir).select("key", "value", "is_delete", "seq")
    for k in range(3):
        store.write(_third(log, k), order="seq")
    store.write(log, order="seq")
    store.flush()
    return store.scan().agg(F.lit(store.last_seq()).cast("long").alias("last_seq"), F.lit(store.memtable_size()).cast("long").alias("unflushed"), F.count("*").alias("n_keys"))


@query("SELECT count(*) AS n_keys FROM newest")
def store_memtable(spark, sf_dir):
    store = _loaded(spark, sf_dir, "memtable")
    return spark.createDataFrame([(store.memtable_size(),)], "n_keys long")


@query(f"SELECT * FROM ({_STATE}) WHERE key >= 'user-15' ORDER BY key LIMIT 1")
def store_seek(spark, sf_dir):
    key, value = _loaded(spark, sf_dir, "seek").seek(b"user-15")
    return spark.createDataFrame([(key.decode(), value.decode())], "key string, value string")


@query(f"SELECT key, value, row_number() OVER (ORDER BY key) AS pos FROM ({_STATE}) WHERE key >= 'user-1' AND key < 'user-11'")
def store_visit(spark, sf_dir):
    """A callback for each key of a short range, in order."""
    store, seen = _loaded(spark, sf_dir, "visit"), []
    store.visit(b"user-1", b"user-11", lambda key, value: seen.append((key.decode(), value.decode(), len(seen) + 1)))
    return spark.createDataFrame(seen, "key string, value string, pos long")


@query("""SELECT key, "offset" FROM (SELECT key, CAST(coalesce(sum(size) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", row_number() OVER (ORDER BY key) AS rn
          FROM (SELECT key, 12 + strlen(key) + CASE WHEN is_delete THEN 13 ELSE strlen(value) END AS size FROM newest)) WHERE (rn - 1) % 4 = 0""")
def store_sparse_index(spark, sf_dir):
    store = _loaded(spark, sf_dir, "index")
    store.flush()  # into one file or many, by the changelog's size
    return _text(store.sparse_index_of_level(0, 4).select("key", "offset"), "key")


@query(_STATE)
def store_ingest(spark, sf_dir):
    """The changelog as a stream into a store, and the same stream again: each batch counts once."""
    from .streaming.changes import read_changes

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    store, marks = Store(spark, _folder(spark, "ingest"), STEPS), _folder(spark, "ingest-marks")
    for _ in range(2):
        store.ingest(read_changes(spark, sf_dir, schema, catalog.to_changes, "events.parquet"), marks, "events").awaitTermination()
    return _state(store.scan())


@query(f"SELECT s.key, s.value FROM ({_STATE}) s WHERE key IN (SELECT 'user-' || c_custkey FROM customer WHERE c_nationkey < 5)")
def store_multi_get(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_nationkey < 5").select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).cast("binary").alias("key"))
    return _state(_loaded(spark, sf_dir, "multi").multi_get(wanted))


@query("SELECT 'GET' AS method, 'a b' AS key, CAST(200 AS INTEGER) AS status, 'put over http' AS body UNION ALL SELECT 'GET', 'none', 404, 'key not found' UNION ALL SELECT 'GET', '', 400, 'missing key' UNION ALL SELECT 'PUT', 'a b', 200, ''")
def http_round_trip(spark, sf_dir):
    import threading
    import urllib.error
    import urllib.parse
    import urllib.request

    from .plans.http import server

    web = server(Store(spark, _folder(spark, "http"), STEPS), port=0)
    threading.Thread(target=web.serve_forever, daemon=True).start()

    def call(method: str, key: str, body: bytes | None = None) -> tuple:
        url = f"http://127.0.0.1:{web.server_address[1]}/{method.lower()}?key={urllib.parse.quote(key)}"
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, method=method)) as answer:
                return method, key, answer.status, answer.read().decode()
        except urllib.error.HTTPError as e:
            return method, key, e.code, e.read().decode()

    found = [call("PUT", "a b", b"put over http"), call("GET", "a b"), call("GET", "none"), call("GET", "")]
    web.shutdown()
    return spark.createDataFrame(found, "method string, key string, status int, body string")


@query("SELECT key, value, is_delete FROM newest")
def merge_runs_newest_first(spark, sf_dir):
    """The merge contract: of runs ranked by age the youngest one's version of a key wins, deletions kept."""
    ranked = _runs(spark, sf_dir).withColumn("source_priority", -F.col("segment_id"))
    return state.merge_runs(ranked.select("source_priority", "key", "value", "is_delete"), keep_deleted=True).select("key", "value", "is_delete")
