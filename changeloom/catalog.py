"""Registered queries over the sample tables, and the SQL that each equals.

The changelog is the table `events`: key 'user-' || user_id, version event_id, deletions are events of
type 'error', the value is props, a log segment is 2,500 and a transaction 10 consecutive events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import records
from .operators import log as logs
from .operators import runs, state
from .streaming import changes as streams

SEGMENT, BATCH = 2500, 10
SPLIT_BYTES, TRIGGER_BYTES = 1024, 60_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {_CTE} {sql}"
        return f

    return add


def to_changes(events: DataFrame) -> DataFrame:
    deleted = F.col("event_type") == "error"
    return events.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"), F.when(~deleted, F.col("props")).alias("value"), deleted.alias("is_delete"), F.col("event_id").alias("seq"),
        F.floor(F.col("event_id") / SEGMENT).alias("segment_id"), F.floor(F.col("event_id") / BATCH).alias("txn_id"),
    )


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_changes(spark.read.parquet(f"{sf_dir}/events.parquet"))


_CTE = f"""
log AS (SELECT 'user-' || user_id AS key, CASE WHEN event_type <> 'error' THEN props END AS value, event_type = 'error' AS is_delete,
        event_id AS seq, event_id // {SEGMENT} AS segment_id, event_id // {BATCH} AS txn_id FROM events),
newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
state AS (SELECT key, value, seq FROM newest WHERE NOT is_delete),
run AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY segment_id, key ORDER BY seq DESC) = 1),
sized AS (SELECT *, CAST(12 + strlen(key) + CASE WHEN is_delete THEN 13 ELSE coalesce(strlen(value), 0) END AS BIGINT) AS size FROM run),
man AS (SELECT segment_id, CAST(0 AS INTEGER) AS level, min(key) AS min_key, max(key) AS max_key, count(*) AS n_records, CAST(sum(size) AS BIGINT) AS bytes FROM sized GROUP BY segment_id),
idx AS (SELECT segment_id, key, "offset" FROM (SELECT segment_id, key, CAST(coalesce(sum(size) OVER (PARTITION BY segment_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
        row_number() OVER (PARTITION BY segment_id ORDER BY key) AS rn FROM sized) WHERE (rn - 1) % 2 = 0)
"""


@query("SELECT * FROM state")
def latest_state(spark, sf_dir):
    return state.current_state(changelog(spark, sf_dir))


@query("SELECT * FROM state WHERE key = 'user-42'")
def point_get(spark, sf_dir):
    return state.point_get(changelog(spark, sf_dir), "user-42")


@query("SELECT s.* FROM state s WHERE key IN (SELECT 'user-' || c_custkey FROM customer WHERE c_nationkey < 5)")
def multi_get(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_nationkey < 5").select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("key"))
    return state.multi_get(changelog(spark, sf_dir), wanted)


@query("SELECT * FROM state WHERE key >= 'user-1' AND key < 'user-2'")
def range_scan(spark, sf_dir):
    return state.range_scan(changelog(spark, sf_dir), "user-1", "user-2")


@query("SELECT * FROM state WHERE key >= 'user-5'")
def range_scan_unbounded(spark, sf_dir):
    return state.range_scan(changelog(spark, sf_dir), "user-5", None)


@query("SELECT * FROM state WHERE key >= 'user-2' AND key < 'user-1'")
def range_scan_empty(spark, sf_dir):
    return state.range_scan(changelog(spark, sf_dir), "user-2", "user-1")


@query("SELECT * FROM state WHERE key >= 'user-15' ORDER BY key LIMIT 1")
def lower_bound_seek(spark, sf_dir):
    return state.lower_bound(changelog(spark, sf_dir), "user-15")


@query("SELECT *, row_number() OVER (ORDER BY key) AS pos FROM state")
def ordered_scan(spark, sf_dir):
    return state.with_position(latest_state(spark, sf_dir))


@query("SELECT key, value, seq FROM (SELECT * FROM log WHERE seq <= 5000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT is_delete")
def as_of_seq(spark, sf_dir):
    return state.as_of(changelog(spark, sf_dir), 5000)


def _runs(spark, sf_dir):
    return runs.flush(changelog(spark, sf_dir)).select("segment_id", "key", "value", "is_delete", "seq")


@query("SELECT segment_id, key, value, is_delete, seq FROM run")
def flush_segments(spark, sf_dir):
    return _runs(spark, sf_dir)


@query("SELECT * FROM man")
def segment_manifest(spark, sf_dir):
    return runs.manifest(_runs(spark, sf_dir))


@query("SELECT * FROM idx")
def sparse_index(spark, sf_dir):
    return runs.sparse_index(_runs(spark, sf_dir))


@query("""SELECT s.segment_id, k.key, coalesce((SELECT max_by(i."offset", i.key) FROM idx i WHERE i.segment_id = s.segment_id AND i.key <= k.key), -1) AS "offset"
          FROM (SELECT DISTINCT segment_id FROM idx) s, (SELECT DISTINCT key FROM newest WHERE is_delete) k""")
def sparse_floor_lookup(spark, sf_dir):
    wanted = state.newest(changelog(spark, sf_dir)).where("is_delete")
    return runs.sparse_floor(sparse_index(spark, sf_dir), wanted)


@query("SELECT k.key, m.segment_id, m.level FROM (SELECT DISTINCT key FROM log) k JOIN man m ON m.min_key <= k.key AND k.key <= m.max_key")
def interval_prune(spark, sf_dir):
    return runs.interval_prune(changelog(spark, sf_dir), segment_manifest(spark, sf_dir))


_PAIRS = "SELECT a.segment_id AS left_id, b.segment_id AS right_id FROM man a JOIN man b ON a.level = b.level AND a.segment_id < b.segment_id AND a.max_key {0} b.min_key AND b.max_key {0} a.min_key"


@query(_PAIRS.format(">"))
def segment_overlap_strict(spark, sf_dir):
    return runs.overlapping(segment_manifest(spark, sf_dir), strict=True)


@query(_PAIRS.format(">="))
def segment_overlap(spark, sf_dir):
    return runs.overlapping(segment_manifest(spark, sf_dir))


@query(f"SELECT level, count(*) AS n_segments, CAST(sum(bytes) AS BIGINT) AS bytes, (level = 0 AND count(*) >= 4) OR sum(bytes) >= {TRIGGER_BYTES} AS triggered FROM man GROUP BY level")
def compaction_trigger(spark, sf_dir):
    return runs.compaction_triggers(segment_manifest(spark, sf_dir), TRIGGER_BYTES)


@query("SELECT m.segment_id, m.level FROM man m WHERE m.level = 0")
def compaction_plan(spark, sf_dir):
    return runs.compaction_inputs(segment_manifest(spark, sf_dir), 0).select("segment_id", "level")


@query("SELECT key, value, is_delete, seq FROM newest WHERE NOT is_delete")
def compaction_merge(spark, sf_dir):
    return runs.compact(_runs(spark, sf_dir))


@query("SELECT key, value, is_delete, seq FROM newest")
def compaction_merge_keep_tombstones(spark, sf_dir):
    return runs.compact(_runs(spark, sf_dir), bottom=False)


@query(f"""k AS (SELECT key, CAST(12 + strlen(key) + strlen(value) AS BIGINT) AS size, row_number() OVER (ORDER BY key) AS rn FROM state),
          fold AS (SELECT rn, key, size, 0 AS part, CAST(0 AS BIGINT) AS "offset" FROM k WHERE rn = 1
                   UNION ALL SELECT k.rn, k.key, k.size, CASE WHEN f."offset" + f.size + k.size > {SPLIT_BYTES} THEN f.part + 1 ELSE f.part END,
                   CASE WHEN f."offset" + f.size + k.size > {SPLIT_BYTES} THEN 0 ELSE f."offset" + f.size END FROM fold f JOIN k ON k.rn = f.rn + 1)
          SELECT key, size, CAST(part AS INTEGER) AS part, "offset" FROM fold""".replace("k AS (", ", k AS (", 1))
def segment_split(spark, sf_dir):
    return runs.split(compaction_merge(spark, sf_dir), SPLIT_BYTES)


SQL["segment_split"] = SQL["segment_split"].replace("WITH ", "WITH RECURSIVE ", 1)

_CUTS = ["user-2", "user-4", "user-6", "user-8"]
_RANGE = " + ".join(f"CAST(key >= '{c}' AS INTEGER)" for c in _CUTS)


@query(f""", k AS (SELECT key, CAST(12 + strlen(key) + strlen(value) AS BIGINT) AS size, {_RANGE} AS "range", row_number() OVER (PARTITION BY {_RANGE} ORDER BY key) AS rn FROM state),
          fold AS (SELECT rn, key, size, "range", 0 AS part, CAST(0 AS BIGINT) AS "offset" FROM k WHERE rn = 1
                   UNION ALL SELECT k.rn, k.key, k.size, k."range", CASE WHEN f."offset" + f.size + k.size > {SPLIT_BYTES} THEN f.part + 1 ELSE f.part END,
                   CASE WHEN f."offset" + f.size + k.size > {SPLIT_BYTES} THEN 0 ELSE f."offset" + f.size END FROM fold f JOIN k ON k.rn = f.rn + 1 AND k."range" = f."range")
          SELECT key, size, CAST("range" AS INTEGER) AS "range", CAST(part AS INTEGER) AS part, "offset" FROM fold""")
def segment_split_ranges(spark, sf_dir):
    """The parallel form, with fixed cuts as SQL has to know them."""
    return runs.split_in_ranges(compaction_merge(spark, sf_dir), SPLIT_BYTES, len(_CUTS) + 1, _CUTS)


SQL["segment_split_ranges"] = SQL["segment_split_ranges"].replace("WITH ", "WITH RECURSIVE ", 1)

#: A manifest of three levels: the flushed runs, and disjoint runs by the first (level 1) and the first two (level 2) digits of the user id.
_LEVELS = """, deep AS (SELECT 'user-' || c AS p, CAST(l AS INTEGER) AS level, 1000 * l + CAST(c AS BIGINT) AS segment_id FROM (SELECT range AS c, 1 AS l FROM range(1, 10) UNION ALL SELECT range, 2 FROM range(10, 100))),
levels AS (SELECT segment_id, level, min_key, max_key, n_records, bytes FROM man UNION ALL
           SELECT d.segment_id, any_value(d.level), min(key), max(key), count(*), CAST(sum(12 + strlen(key) + strlen(value)) AS BIGINT) FROM state JOIN deep d ON substr(key, 1, strlen(d.p)) = d.p GROUP BY d.segment_id)"""


def level_manifest(spark, sf_dir) -> DataFrame:
    own = latest_state(spark, sf_dir).where("key <> 'user-0'").withColumn("is_delete", F.lit(False))
    whole = segment_manifest(spark, sf_dir)
    for level, width in ((1, 6), (2, 7)):
        at = F.substring("key", 6, level)
        deep = own.where(F.length("key") >= width).withColumn("segment_id", 1000 * level + at.cast("long"))
        whole = whole.unionByName(runs.manifest(deep, level=level))
    return whole


@query(f"{_LEVELS}, span AS (SELECT min(min_key) AS lo, max(max_key) AS hi FROM levels WHERE level = 0) SELECT segment_id, level FROM levels, span WHERE level = 0 OR (level = 1 AND max_key >= lo AND min_key <= hi)")
def compaction_plan_levels(spark, sf_dir):
    return runs.compaction_inputs(level_manifest(spark, sf_dir), 0).select("segment_id", "level")


@query(f"""{_LEVELS}, base AS (SELECT * FROM levels WHERE level = 1 ORDER BY min_key, segment_id LIMIT 1)
          SELECT segment_id, level FROM base UNION ALL SELECT l.segment_id, l.level FROM levels l, base b WHERE l.level = 2 AND l.max_key >= b.min_key AND l.min_key <= b.max_key""")
def compaction_plan_deep(spark, sf_dir):
    return runs.compaction_inputs(level_manifest(spark, sf_dir), 1).select("segment_id", "level")


@query(f"{_LEVELS} SELECT level, count(*) AS n_segments, CAST(sum(bytes) AS BIGINT) AS bytes, (level = 0 AND count(*) >= 4) OR sum(bytes) >= {TRIGGER_BYTES} AS triggered FROM levels GROUP BY level")
def compaction_trigger_levels(spark, sf_dir):
    return runs.compaction_triggers(level_manifest(spark, sf_dir), TRIGGER_BYTES)


@query(f"{_LEVELS} SELECT a.segment_id AS left_id, b.segment_id AS right_id FROM levels a JOIN levels b ON a.level = b.level AND a.segment_id < b.segment_id AND a.max_key >= b.min_key AND b.max_key >= a.min_key")
def segment_overlap_levels(spark, sf_dir):
    return runs.overlapping(level_manifest(spark, sf_dir))


@query("""SELECT CAST(sum(c) AS BIGINT) AS n_input, CAST(sum(c - 1) AS BIGINT) AS n_duplicates, count(*) FILTER (is_delete) AS n_deleted, count(*) FILTER (NOT is_delete) AS n_output
          FROM (SELECT key, count(*) AS c, arg_max(is_delete, seq) AS is_delete FROM run GROUP BY key)""")
def merge_stats(spark, sf_dir):
    return runs.merge_stats(_runs(spark, sf_dir))


@query("""SELECT segment_id, level, min_key, max_key, n_records, bytes FROM man WHERE segment_id >= 2
          UNION ALL SELECT 1000, 1, min(key), max(key), count(*), CAST(sum(12 + strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) FROM
          (SELECT * FROM (SELECT * FROM run WHERE segment_id < 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT is_delete)""")
def new_levels(spark, sf_dir):
    old = segment_manifest(spark, sf_dir)
    merged = runs.compact(_runs(spark, sf_dir).where("segment_id < 2")).withColumn("segment_id", F.lit(1000).cast("long"))
    return runs.new_layout(old, old.where("segment_id < 2"), runs.manifest(merged, level=1))


@query("SELECT key, segment_id, is_delete FROM newest")
def serving_segment(spark, sf_dir):
    return runs.serving_run(_runs(spark, sf_dir))


def _batches(spark, sf_dir):
    return logs.commit_batches(changelog(spark, sf_dir).select("txn_id", "key", "value", "is_delete", "seq"))


@query("SELECT txn_id, key, value, is_delete, seq FROM log QUALIFY row_number() OVER (PARTITION BY txn_id, key ORDER BY seq DESC) = 1")
def commit_batches(spark, sf_dir):
    return logs.explode_ops(_batches(spark, sf_dir))


#: In `torn_tail` so many records at the end of the log do not match their checksums.
_TORN = 100


@query("SELECT key, value, segment_id AS wal_id, seq FROM newest WHERE NOT is_delete")
def wal_replay(spark, sf_dir):
    ops = logs.explode_ops(_batches(spark, sf_dir)).withColumn("wal_id", F.floor(F.col("seq") / SEGMENT))
    return logs.replay(ops)


@query(f"SELECT segment_id AS wal_id, seq, key FROM log WHERE seq < (SELECT max(seq) - {_TORN} FROM log)")
def torn_tail(spark, sf_dir):
    wal = changelog(spark, sf_dir).withColumnRenamed("segment_id", "wal_id")
    end = wal.agg(F.max("seq").alias("end"))  # one row
    return logs.readable(wal.join(F.broadcast(end)).withColumn("checksum_ok", F.col("seq") < F.col("end") - _TORN)).select("wal_id", "seq", "key")


@query("SELECT txn_id, key, seq FROM log WHERE txn_id % 7 <> 3")
def rollback_filter(spark, sf_dir):
    log = changelog(spark, sf_dir)
    return logs.committed(log, log.where("txn_id % 7 = 3")).select("txn_id", "key", "seq")


@query("""buf AS (SELECT * FROM newest WHERE seq % 3 = 0),
          base AS (SELECT * FROM (SELECT * FROM log WHERE seq % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT is_delete)
          SELECT key, value FROM base WHERE key NOT IN (SELECT key FROM buf) UNION ALL SELECT key, value FROM buf WHERE NOT is_delete""".replace("buf AS", ", buf AS", 1))
def txn_overlay(spark, sf_dir):
    log = changelog(spark, sf_dir)
    return state.overlay(state.current_state(log.where("seq % 3 <> 0")), state.newest(log).where("seq % 3 = 0").select("key", "value", "is_delete"))


@query("""SELECT key, txn_id AS first_txn, nxt AS second_txn FROM (SELECT key, txn_id, lead(txn_id) OVER (PARTITION BY key, txn_id // 20 ORDER BY txn_id) AS nxt
          FROM (SELECT DISTINCT key, txn_id FROM log)) WHERE nxt IS NOT NULL""")
def write_conflicts(spark, sf_dir):
    return logs.write_conflicts(changelog(spark, sf_dir), 20)


@query("SELECT segment_id, count(DISTINCT key) AS n_keys FROM log GROUP BY segment_id")
def memtable_size(spark, sf_dir):
    return changelog(spark, sf_dir).groupBy("segment_id").agg(F.countDistinct("key").alias("n_keys"))


@query("SELECT segment_id, key, size FROM sized")
def record_size(spark, sf_dir):
    return _runs(spark, sf_dir).select("segment_id", "key", records.record_size(F.col("key"), F.col("value"), F.col("is_delete")).alias("size"))


def crc_sql(rows: str, hexed: str, columns: str, name: str) -> str:
    """SQL text: `columns` and the CRC-32 `name` of the bytes whose hexadecimal digits are `hexed`, over `rows`; the table of remainders comes from its rule."""
    return f"""(WITH RECURSIVE rounds AS (SELECT range AS i, 0 AS k, range AS c FROM range(256)
            UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM rounds WHERE k < 8),
        tab AS (SELECT list(c ORDER BY i) AS t FROM rounds WHERE k = 8), src AS (SELECT *, {hexed} AS h FROM {rows}),
        src2 AS (SELECT *, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b FROM src)
        SELECT {columns}, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295) AS BIGINT) AS {name} FROM src2, tab)"""


def le_sql(number: str, size: int) -> str:
    """SQL text: hexadecimal digits of a number's lowest `size` bytes, lowest first."""
    digits = f"lpad(hex({number}), 16, '0')"
    return " || ".join(f"substr({digits}, {15 - 2 * k}, 2)" for k in range(size))


_BODY = f"{le_sql('strlen(key)', 4)} || {le_sql('strlen(value)', 4)} || hex(encode(key)) || hex(encode(value))"


@query(f"SELECT * FROM {crc_sql('state', _BODY, 'key', 'checksum')}")
def record_checksum(spark, sf_dir):
    return latest_state(spark, sf_dir).select("key", records.record_checksum(F.col("key"), F.col("value")).alias("checksum"))


@query("SELECT CASE WHEN seq % 5 = 0 THEN '__TOMBSTONE__' ELSE key END AS key, seq FROM log WHERE seq % 5 <> 0")
def valid_keys(spark, sf_dir):
    marked = changelog(spark, sf_dir).select(F.when(F.col("seq") % 5 == 0, F.lit("__TOMBSTONE__")).otherwise(F.col("key")).alias("key"), "seq")
    return marked.where(records.valid_key(F.col("key")))


@query("SELECT segment_id, row_number() OVER (ORDER BY segment_id DESC) AS pos, 'segment-' || lpad(CAST(segment_id AS VARCHAR), 6, '0') AS name FROM (SELECT DISTINCT segment_id FROM log)")
def segment_ids_desc(spark, sf_dir):
    from pyspark.sql import Window

    ids = changelog(spark, sf_dir).select("segment_id").distinct()  # a row per segment
    return ids.select("segment_id", F.row_number().over(Window.orderBy(F.desc("segment_id"))).cast("long").alias("pos"), records.file_name("segment", F.col("segment_id")).alias("name"))


@query("SELECT max(seq) AS last_seq, max(segment_id) AS last_segment FROM log")
def last_positions(spark, sf_dir):
    return changelog(spark, sf_dir).agg(F.max("seq").alias("last_seq"), F.max("segment_id").alias("last_segment"))


@query("SELECT * FROM state")
def stream_latest(spark, sf_dir):
    """The same fold as a stream that runs to the end of the table."""
    import uuid

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    known = spark.conf.get("spark.checkpoint.dir", None)
    root = (known or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    log = streams.read_changes(spark, sf_dir, schema, lambda events: to_changes(events).select("key", "value", "is_delete", "seq"), "events.parquet")
    return streams.drain(log, f"{root}/stream-{uuid.uuid4().hex}")


def _state_of(table: str, key: str, seq: str, value: str, deleted: str, sql_key: str):
    sql = f"SELECT key, value, seq FROM (SELECT {sql_key} AS key, {value} AS value, {deleted} AS d, {seq} AS seq FROM {table} QUALIFY row_number() OVER (PARTITION BY {sql_key} ORDER BY {seq} DESC) = 1) WHERE NOT d"

    def run(spark, sf_dir):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.expr(key).alias("key"), F.expr(value).alias("value"), F.expr(deleted).alias("is_delete"), F.expr(seq).alias("seq"))
        return state.current_state(rows)

    QUERIES[f"latest_{table}"], SQL[f"latest_{table}"] = run, sql


_state_of("orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus = 'F'", "o_custkey")
_state_of("lineitem", "l_partkey", "l_orderkey * 8 + l_linenumber", "l_extendedprice", "l_returnflag = 'R'", "l_partkey")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
