"""The operators on small tables: merge contract, ties, layout algebra, offsets, log rules and key rules."""

import pytest
from changeloom import catalog
from changeloom.functions import records as rec
from changeloom.operators import log as logs
from changeloom.operators import runs, state
from pyspark.sql import functions as F

RUN = "source_priority int, key string, value string, is_delete boolean"


def merged(spark, *sources, **kw):
    rows = [(p, k, v, v is None) for p, source in enumerate(sources) for k, v in source]
    return [(r.key, r.value) for r in state.merge_runs(spark.createDataFrame(rows, RUN), **kw).orderBy("key").collect()]


@pytest.mark.parametrize(
    "sources, want",
    [
        (([("b", "mem_b")], [("a", "seg_a"), ("c", "seg_c")]), [("a", "seg_a"), ("b", "mem_b"), ("c", "seg_c")]),
        (([("apple", "new"), ("cat", "mem")], [("apple", "old"), ("banana", "one")], [("banana", "older"), ("dog", "two")]), [("apple", "new"), ("banana", "one"), ("cat", "mem"), ("dog", "two")]),
        (([("apple", None)], [("apple", "old"), ("banana", "b")]), [("banana", "b")]),
        (([], [("a", "a"), ("b", "b")], []), [("a", "a"), ("b", "b")]),
        (([],), []),
    ],
)
def test_merge_contract(spark, sources, want):
    assert merged(spark, *sources) == want


def test_merge_keeps_deletions_on_request(spark):
    assert merged(spark, [("a", None)], [("a", "old"), ("b", "b")], keep_deleted=True) == [("a", None), ("b", "b")]


LOG = "key string, value string, is_delete boolean, seq long"


def test_state_reads(spark):
    log = spark.createDataFrame([("a", "1", False, 1), ("b", "1", False, 2), ("a", "2", False, 3), ("b", None, True, 4), ("c", None, False, 5), ("", "empty", False, 6)], LOG)
    got = lambda df: sorted((r.key, r.value) for r in df.collect())
    assert got(state.current_state(log)) == [("", "empty"), ("a", "2"), ("c", None)]
    assert got(state.as_of(log, 2)) == [("a", "1"), ("b", "1")]
    assert got(state.point_get(log, "b")) == [] and got(state.point_get(log, "a")) == [("a", "2")]
    assert got(state.multi_get(log, spark.createDataFrame([("a",), ("a",), ("b",), ("zz",)], "key string"))) == [("a", "2")]
    assert got(state.range_scan(log, "a", "c")) == [("a", "2")] and got(state.range_scan(log, None, "a")) == [("", "empty")]
    assert got(state.range_scan(log, "b", None)) == [("c", None)] and got(state.range_scan(log, "b", "a")) == []
    assert got(state.lower_bound(log, "b")) == [("c", None)] and got(state.lower_bound(log, "d")) == []
    buffer = spark.createDataFrame([("a", None, True), ("n", "new", False)], "key string, value string, is_delete boolean")
    assert got(state.overlay(state.current_state(log), buffer)) == [("", "empty"), ("c", None), ("n", "new")]


def test_positions_over_several_ranges(spark):
    keys = [f"k{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "key string").repartition(5)
    got = {r.key: r.pos for r in state.with_position(df, 7).collect()}
    assert got == {k: i + 1 for i, k in enumerate(keys)}


def test_plans(spark, sf):
    log = catalog.changelog(spark, sf)
    plan = state.current_state(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") == 2 and "partial_max_by" in plan and "Window" not in plan
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.lit(False).alias("is_delete"), F.col("o_totalprice").alias("value"))
    plan = state.point_get(rows, 7)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan


def test_index_offsets_and_floor(spark):
    rows = spark.createDataFrame([(1, f"key{i}", f"value{i}", False, i) for i in range(1, 6)], "segment_id long, key string, value string, is_delete boolean, seq long")
    index = runs.sparse_index(rows, every=1)
    assert [r.offset for r in index.orderBy("key").collect()] == [0, 22, 44, 66, 88]
    assert [r.key for r in runs.sparse_index(rows).orderBy("key").collect()] == ["key1", "key3", "key5"]
    wanted = spark.createDataFrame([("key0",), ("key1",), ("key34",), ("key9",)], "key string")
    assert {r.key: r.offset for r in runs.sparse_floor(index, wanted).collect()} == {"key0": -1, "key1": 0, "key34": 44, "key9": 88}
    assert runs.sparse_floor(index.limit(0), wanted).collect() == []


META = "segment_id long, level int, min_key string, max_key string, n_records long, bytes long"


def test_layout(spark):
    old = spark.createDataFrame([(1, 0, "a", "c", 1, 10), (2, 1, "b", "d", 1, 10), (3, 1, "x", "z", 1, 10)], META)
    new = spark.createDataFrame([(4, 1, "a", "b", 1, 10), (5, 1, "c", "d", 1, 10)], META)
    inputs = runs.compaction_inputs(old, 0)
    assert sorted(r.segment_id for r in inputs.collect()) == [1, 2]
    after = runs.new_layout(old, inputs, new)
    assert sorted((r.level, r.segment_id) for r in after.collect()) == [(1, 3), (1, 4), (1, 5)]
    assert [r.segment_id for r in runs.compaction_inputs(after, 1).collect()] == [4]


def test_overlap_rules(spark):
    m = spark.createDataFrame([(1, 0, "a", "c", 1, 1), (2, 0, "c", "e", 1, 1), (3, 0, "f", "g", 1, 1), (4, 1, "a", "z", 1, 1)], META)
    assert [(r.left_id, r.right_id) for r in runs.overlapping(m).collect()] == [(1, 2)]
    assert runs.overlapping(m, strict=True).collect() == []
    keys = spark.createDataFrame([("c",), ("f5",), ("zz",)], "key string")
    assert sorted((r.key, r.segment_id) for r in runs.interval_prune(keys, m).collect()) == [("c", 1), ("c", 2), ("c", 4), ("f5", 3), ("f5", 4)]


def test_triggers(spark):
    m = spark.createDataFrame([(i, 0, "a", "b", 1, 1) for i in range(4)] + [(9, 1, "a", "b", 1, 50), (10, 2, "a", "b", 1, 100)], META)
    assert {r.level: r.triggered for r in runs.compaction_triggers(m, 100).collect()} == {0: True, 1: False, 2: True}


def test_split(spark):
    """No empty part before an oversized record; each part as long as it can be."""
    sizes = [100, 10, 30, 5, 90, 3, 3, 3]
    rows = spark.createDataFrame([(f"k{i}", "x" * (s - 14), False) for i, s in enumerate(sizes) if s >= 14] + [(f"k{i}", "", False) for i, s in enumerate(sizes) if s < 14], "key string, value string, is_delete boolean")
    got = runs.split(rows, 60).orderBy("key").collect()
    part = offset = 0
    for r in got:
        if offset and offset + r.size > 60:
            part, offset = part + 1, 0
        assert (r.part, r.offset) == (part, offset)
        offset += r.size
    assert got[0].part == 0 and got[1].part == 1
    ranged = runs.split_in_ranges(rows, 60, 3).collect()
    assert len(ranged) == 8 and all(r.offset + r.size <= 60 or r.offset == 0 for r in ranged)
    assert runs.split(rows.limit(0), 60).collect() == []


def test_log_rules(spark):
    ops = spark.createDataFrame([(1, "a", "1", False, 1), (1, "a", "2", False, 2), (1, "b", None, True, 3), (2, "a", None, True, 4)], "txn_id long, key string, value string, is_delete boolean, seq long")
    batches = logs.commit_batches(ops)
    assert {r.txn_id: [(o.key, o.value, o.is_delete) for o in r.ops] for r in batches.collect()} == {1: [("a", "2", False), ("b", None, True)], 2: [("a", None, True)]}
    assert logs.explode_ops(batches).count() == 3
    assert [r.key for r in logs.committed(ops, spark.createDataFrame([(1,)], "txn_id long")).collect()] == ["a"]
    wal = "wal_id long, seq long, checksum_ok boolean"
    torn = spark.createDataFrame([(1, 1, True), (2, 1, True), (2, 2, False), (2, 3, True)], wal)
    assert sorted((r.wal_id, r.seq) for r in logs.readable(torn).collect()) == [(1, 1), (2, 1)]
    early = spark.createDataFrame([(1, 1, False), (2, 1, True)], wal)
    with pytest.raises(Exception, match="bad record in log file 1"):
        logs.readable(early).collect()
    # (file, seq) is the order: seq starts anew in each file
    ops = spark.createDataFrame([(1, 9, "a", "old", False), (2, 1, "a", "new", False)], "wal_id long, seq long, key string, value string, is_delete boolean")
    assert [r.value for r in logs.replay(ops).collect()] == ["new"]


def test_record_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert [get(rec.checksum(F.lit(v))) for v in (b"", b"hello", bytes([1, 2, 3, 4, 5]))] == [0, 907060870, 1191942644]
    assert bytes(get(rec.little_endian(F.lit(0x01020304), 4))) == bytes([4, 3, 2, 1])
    assert get(rec.from_little_endian(F.lit(bytes([4, 3, 2, 1])), 4)) == 0x01020304
    assert get(rec.file_name("segment", F.lit(7))) == "segment-000007" and get(rec.file_name("wal", F.lit(12345678))) == "wal-12345678"
    assert get(rec.number_of(F.lit("/x/segment-000042"), "segment")) == 42 and get(rec.number_of(F.lit("/x/segment-tmp-000042"), "segment")) is None
    keys = spark.createDataFrame([(k,) for k in ("", "a", None, "__TOMBSTONE__", "__CHECKPOINT__")], "key string")
    assert [r.key for r in keys.where(rec.valid_key(F.col("key"))).collect()] == ["", "a"]


def test_stream_folds_in_batches(spark, tmp_path):
    from changeloom.streaming import changes

    for k, rows in enumerate([[("a", "1", False, 1), ("b", "1", False, 2)], [("a", "2", False, 3), ("b", None, True, 4)], [("a", "late", False, 0)]]):
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{tmp_path}/in/x={k}")
    stream = spark.readStream.schema(LOG).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert [(r.key, r.value) for r in changes.drain(stream, f"{tmp_path}/ckpt").collect()] == [("a", "2")]


def test_stream_merges_its_runs(spark, tmp_path, monkeypatch):
    from changeloom.streaming import changes

    monkeypatch.setattr(changes, "MERGE_BATCHES", 2)
    for k in range(5):
        spark.createDataFrame([("a", str(k), False, 10 - k), (f"k{k}", "x", k == 3, k)], LOG).coalesce(1).write.parquet(f"{tmp_path}/in/x={k}")
    read = lambda: spark.readStream.schema(LOG).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = lambda: sorted((r.key, r.value, r.seq) for r in changes.drain(read(), f"{tmp_path}/state").collect())
    want = [("a", "0", 10), ("k0", "x", 0), ("k1", "x", 1), ("k2", "x", 2), ("k4", "x", 4)]
    assert got() == want
    import os

    runs = [d for d in os.listdir(f"{tmp_path}/state/runs") if not d.startswith(".")]
    assert len(runs) <= 2 and any(d.startswith("merged-") for d in runs)
    spark.createDataFrame([("a", None, True, 99)], LOG).coalesce(1).write.parquet(f"{tmp_path}/in/x=9")
    assert got() == want[1:]
    # a batch that is run again counts once
    fold = changes.Fold(spark, f"{tmp_path}/again")
    rows = spark.createDataFrame([("a", "1", False, 1)], LOG)
    for _ in range(3):
        fold.apply(rows, 0)
    assert fold.log(rows.schema).count() == 1


def test_ranges(spark):
    from changeloom.operators import ranges

    keys = [f"k{i:03d}" for i in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    cuts = ranges.bounds(df, 8)
    assert cuts == sorted(set(cuts)) and 4 <= len(cuts) <= 7 and ranges.bounds(df.repartition(3), 8) == cuts
    got = {r.key: r.n for r in df.select("key", ranges.range_of(F.col("key"), df.schema["key"].dataType, cuts).alias("n")).collect()}
    assert got == {k: sum(c <= k for c in cuts) for k in keys}
    assert ranges.bounds(df.limit(0), 8) == [] and ranges.bounds(df, 1) == []
    assert ranges.free_name(spark.createDataFrame([(1, 2)], "`__x` int, y int"), "__x") == "__x_"


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_floor_and_prune_over_many_ranges(spark, kind):
    import random

    rnd = random.Random(4)
    cast = lambda df, *cs: df.select(*(F.col(c).cast(kind).alias(c) if c in cs else F.col(c) for c in df.columns))
    entries = sorted({(s, f"k{rnd.randrange(400):03d}") for s in range(3) for _ in range(40)} | {(7, "k200")})
    index = cast(spark.createDataFrame([(s, k, i) for i, (s, k) in enumerate(entries)], "segment_id long, key string, offset long"), "key")
    asked = [f"k{i:03d}" for i in range(0, 400, 3)]
    got = {(r.segment_id, r.key if kind == "string" else bytes(r.key).decode()): r.offset for r in runs.sparse_floor(index, cast(spark.createDataFrame([(k,) for k in asked], "key string"), "key"), 9).collect()}
    want = {(s, k): max([i for i, (t, e) in enumerate(entries) if t == s and e <= k], default=-1) for s in (0, 1, 2, 7) for k in asked}
    assert got == want
    spans = [(i, i % 2, *sorted((f"k{rnd.randrange(400):03d}", f"k{rnd.randrange(400):03d}"))) for i in range(60)]
    m = cast(spark.createDataFrame([(*s, 1, 1) for s in spans], META), "min_key", "max_key")
    plan = runs.interval_prune(cast(spark.createDataFrame([(k,) for k in asked], "key string"), "key"), m, 9)
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    found = sorted((r.key if kind == "string" else bytes(r.key).decode(), r.segment_id) for r in plan.collect())
    assert found == sorted((k, i) for k in asked for i, _, lo, hi in spans if lo <= k <= hi)
