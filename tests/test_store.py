"""The persistent store against a dict, and the situations of recovery, compaction and transactions."""

import random
import threading

import pytest
from changeloom.plans.store import Closed, Conflict, Options, Store
from changeloom.sources import codec
from pyspark.sql import functions as F

QUIET = Options(flush_keys=None, flush_bytes=None, compaction=False)


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def rows(spark, pairs):
    return spark.createDataFrame([(k.encode(), None if v is None else v.encode(), v is None) for k, v in pairs], "key binary, value binary, is_delete boolean")


def state(store):
    return {k.decode(): v.decode() for k, v in store.collect_range(None, None)}


def test_put_get_delete_reopen(spark, root):
    s = Store(spark, root, QUIET)
    assert s.get(b"a") is None and s.last_seq() == 0
    s.put(b"a", b"1")
    s.put(b"b", b"")
    s.put(b"a", b"2")
    s.delete(b"b")
    s.delete(b"never there")
    assert s.get(b"a") == b"2" and s.get(b"b") is None
    again = Store(spark, root, QUIET)
    assert state(again) == {"a": "2"} and again.last_seq() == 5
    s.close()
    with pytest.raises(Closed):
        s.get(b"a")
    again.destroy()
    assert Store(spark, root).last_seq() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_against_dict(spark, root, seed):
    """Random batches, flushes, compactions and reopenings keep state == dict and scan == sorted(dict)."""
    rnd, model = random.Random(seed), {}
    opts = Options(flush_keys=25, l0_runs=2, file_bytes=400, level_bytes=600)
    s = Store(spark, root, opts)
    for step in range(7):
        batch = {f"k{rnd.randrange(40):02d}": None if rnd.random() < 0.3 else f"v{step}-{rnd.randrange(1000)}" for _ in range(rnd.randint(1, 18))}
        s.write(rows(spark, batch.items()), parts=2)
        for k, v in batch.items():
            model.pop(k, None) if v is None else model.__setitem__(k, v)
        act = rnd.choice(["flush", "compact", "reopen", "vacuum", "none"])
        if act == "reopen":
            s = Store(spark, root, opts)
        elif act != "none":
            getattr(s, act)()
    assert state(s) == model
    assert [k for k, _ in s.collect_range(None, None)] == sorted(k.encode() for k in model)
    assert [k for k, _ in s.iterator(b"k1", b"k3")] == sorted(k.encode() for k in model if "k1" <= k < "k3")
    levels = s.manifest().where("level >= 1").orderBy("level", "min_key").collect()
    for a, b in zip(levels, levels[1:]):
        assert a.level != b.level or a.max_key < b.min_key, "runs of a level are disjoint"


def test_partial_compaction_keeps_hidden_keys_hidden(spark, root):
    """A deletion may only go at the bottom: an older version below must not come back."""
    s = Store(spark, root, QUIET)
    s.write(rows(spark, [("a", "old"), ("b", "old"), ("z", "old")]))
    s.flush(), s.compact(0), s.compact(1)  # noqa: B018  now in level 2
    assert {f.level for f in s.current().files} == {2}
    s.write(rows(spark, [("a", None), ("b", "new")]))
    s.flush(), s.compact(0)  # noqa: B018  level 1 above level 2
    assert state(s) == {"b": "new", "z": "old"}
    assert s.log().where("is_delete").count() == 1
    s.compact(1)
    assert state(s) == {"b": "new", "z": "old"} and s.log().where("is_delete").count() == 0


def test_newest_of_flushed_runs_wins_in_scans(spark, root):
    s = Store(spark, root, QUIET)
    for v in ("1", "2", "3"):
        s.put(b"k", v.encode())
        s.flush()
    assert s.get(b"k") == b"3" and state(s) == {"k": "3"}


def test_ranges_and_empty_keys(spark, root):
    s = Store(spark, root, QUIET)
    s.write(rows(spark, [(c, c) for c in ["", *"abcdefghijklmnopqrstuvwxyz"]]))
    assert len(s.collect_range(b"a", b"z")) == 25
    assert len(s.collect_range(b"x", None)) == 3 and len(s.collect_range(None, b"b")) == 2
    assert s.collect_range(b"c", b"c") == [] and s.collect_range(b"d", b"c") == []
    assert s.get(b"") == b""


def test_only_files_in_range_are_read(spark, root):
    s = Store(spark, root, QUIET)
    s.write(rows(spark, [(f"k{i:03d}", "v") for i in range(100)]), parts=4)
    assert len(s.current().files) == 4
    assert len(s.log(low=b"k000", high=b"k001").inputFiles()) == 1
    plan = s.scan(b"k000", b"k010")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan


def test_invalid_and_repeated_keys(spark, root):
    s = Store(spark, root, QUIET)
    for bad in (b"__TOMBSTONE__", b"__CHECKPOINT__"):
        with pytest.raises(Exception, match="invalid key"):
            s.put(bad, b"x")
        with pytest.raises(ValueError):
            s.begin().put(bad, b"x")
    with pytest.raises(ValueError, match="order"):
        s.write(rows(spark, [("a", "1"), ("a", "2")]), parts=2)
    assert s.last_seq() == 0
    twice = rows(spark, [("a", "1"), ("a", "2"), ("b", "3")]).withColumn("at", F.length("value") + F.col("value").cast("string").cast("int"))
    s.write(twice, order="at")
    assert state(s) == {"a": "2", "b": "3"}
    s.put(b"marker", b"__TOMBSTONE__")  # a value like any other
    assert s.get(b"marker") == b"__TOMBSTONE__"


def test_transactions(spark, root):
    s = Store(spark, root, QUIET)
    t = s.begin()
    t.put(b"key1", b"x")
    t.rollback()
    assert s.get(b"key1") is None and s.begin().get(b"key1") is None
    t = s.begin()
    t.put(b"key1", b"1"), t.put(b"key2", b"2"), t.delete(b"key3")
    assert t.get(b"key1") == b"1" and s.get(b"key1") is None
    assert [bytes(r.key) for r in t.scan().collect()] == [b"key1", b"key2"]
    t.commit()
    assert state(s) == {"key1": "1", "key2": "2"} and s.last_seq() == 1
    with pytest.raises(RuntimeError):
        t.commit()
    # blind writes do not conflict: the last to commit wins
    a, b = s.begin(), s.begin()
    a.put(b"key1", b"a"), b.put(b"key1", b"b")
    a.commit(), b.commit()
    assert s.get(b"key1") == b"b"
    # a reader keeps its version; its writes fail if what it read has changed
    a = s.begin()
    assert a.get_for_update(b"key1") == b"b"
    s.put(b"key1", b"c")
    assert a.get(b"key1") == b"b"
    a.put(b"key2", b"from b")
    with pytest.raises(Conflict):
        a.commit()
    assert s.get(b"key2") == b"2"
    # a commit elsewhere, and a flush, are no conflict
    a = s.begin()
    a.get(b"key1"), a.put(b"key1", b"d")
    s.put(b"other", b"1")
    a.commit()
    assert s.get(b"key1") == b"d"
    s.transact(lambda t: t.put(b"n", str(int(t.get(b"n") or b"0") + 1).encode()))
    assert s.get(b"n") == b"1"


def test_concurrent_writers(spark, root):
    s = Store(spark, root, QUIET)
    errors = []

    def work(k):
        try:
            s.transact(lambda t: t.put(b"n", str(int(t.get(b"n") or b"0") + 1).encode()), attempts=10)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and s.get(b"n") == b"3"


def test_crash_leaves_the_last_version(spark, root):
    s = Store(spark, root, QUIET)
    s.put(b"a", b"1")
    v = s.current()
    # data and manifest are written, the pointer is not yet
    s._files(s.log().withColumn("seq", F.lit(9).cast("long")), -1, 99, 1)
    s.folder.write(f"manifest-{v.number + 1:06d}.json", b"{")
    assert state(Store(spark, root, QUIET)) == {"a": "1"}
    s.put(b"a", b"2")
    assert s.get(b"a") == b"2" and s.vacuum() > 0 and s.get(b"a") == b"2"


def test_damage_is_an_error(spark, root):
    s = Store(spark, root, QUIET)
    s.put(b"a", b"1")
    s.folder.write(f"manifest-{s.current().number:06d}.json", b"{}")
    with pytest.raises(ValueError, match="damaged manifest"):
        s.get(b"a")
    s.folder.write("CURRENT", b"x")
    with pytest.raises(ValueError, match="damaged CURRENT"):
        Store(spark, root)


def test_snapshot_and_restore(spark, root, tmp_path):
    s = Store(spark, root, QUIET)
    s.write(rows(spark, [(f"key{i}", f"value{i}") for i in range(100)]))
    s.delete(b"key7")
    snap = f"file://{tmp_path}/snap"
    assert s.snapshot(snap) == 2
    other = Store(spark, f"file://{tmp_path}/other", QUIET)
    other.put(b"gone", b"1")
    other.restore(snap)
    assert state(other) == state(s) and len(state(other)) == 99
    other.put(b"key7", b"back")
    assert other.get(b"key7") == b"back" and s.get(b"key7") is None


def test_commands(spark, root):
    s = Store(spark, root, QUIET)
    s.apply(codec.encode_command(codec.Op(b"key1", b"value1", False)))
    s.apply(codec.encode_command(codec.Op(b"key2", b"v", False)))
    s.flush()
    s.apply(codec.encode_command(codec.Op(b"key2", None, True)))
    assert state(s) == {"key1": "value1"}


def test_stream_into_store(spark, root, tmp_path):
    src, ckpt = f"{tmp_path}/in", f"{tmp_path}/ckpt"
    schema = "key string, value string, is_delete boolean, seq long"
    spark.createDataFrame([("a", "1", False, 1), ("b", "1", False, 2), ("a", "2", False, 3)], schema).coalesce(1).write.parquet(f"{src}/x=1")
    s = Store(spark, root, QUIET)

    def run():
        q = s.ingest(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src), ckpt, "events")
        q.awaitTermination()

    run()
    assert state(s) == {"a": "2", "b": "1"} and s.last_seq() == 1
    run()
    assert s.last_seq() == 1, "nothing new, no commit"
    spark.createDataFrame([("a", None, True, 4)], schema).coalesce(1).write.parquet(f"{src}/x=2")
    run()
    assert state(s) == {"b": "1"}
    assert s.write(rows(spark, [("z", "again")]), batch=("events", 0)) == s.last_seq() and "z" not in state(s)


def test_http(spark, root):
    import urllib.error
    import urllib.request

    from changeloom.plans.http import server

    s = Store(spark, root, QUIET)
    web = server(s, port=0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{web.server_address[1]}"

    def call(path, data=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data, method="PUT" if data is not None else "GET")) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, b""

    assert call("/put?key=a%20b", b"1") == (200, b"") and call("/get?key=a%20b") == (200, b"1")
    assert call("/get?key=none")[0] == 404 and call("/get")[0] == 400 and call("/put?key=", b"x")[0] == 400
    assert call("/put?key=__TOMBSTONE__", b"x")[0] == 500 and call("/other?key=a")[0] == 404
    web.shutdown()


def test_memtable_and_index(spark, root, capsys):
    s = Store(spark, root, QUIET)
    s.write(rows(spark, [(f"key{i}", f"value{i}") for i in range(1, 6)]), parts=1)
    s.put(b"key1", b"again")
    assert s.memtable_size() == 5
    s.show()
    assert "is_delete" in capsys.readouterr().out
    s.flush()
    assert s.memtable_size() == 0
    (one,) = s.current().files
    assert [r.offset for r in s.sparse_index(one.segment_id, every=2).orderBy("key").collect()] == [0, 43, 87]
    assert s.sparse_index(12345).collect() == []
    assert s.next_segment_id() == 4


def test_index_of_a_level_of_many_files(spark, root):
    s = Store(spark, root, Options(flush_keys=None, flush_bytes=None, compaction=False, file_bytes=200))
    assert s.sparse_index_of_level(0).collect() == []
    pairs = [(f"key{i:03d}", None if i % 7 == 0 else "v" * (i % 11)) for i in range(60)]
    s.write(rows(spark, pairs), parts=3)
    s.flush()
    assert len(s.current().files) > 3
    offset, want = 0, []
    for i, (k, v) in enumerate(pairs):
        if i % 4 == 0:
            want.append((k.encode(), offset))
        offset += 12 + len(k) + (13 if v is None else len(v))
    got = s.sparse_index_of_level(0, every=4)
    assert [(bytes(r.key), r.offset) for r in got.orderBy("key").collect()] == want
    assert {r.segment_id for r in got.collect()} <= {f.segment_id for f in s.current().files}
    s.put(b"key030", b"again")
    s.flush()
    with pytest.raises(ValueError, match="overlap"):
        s.sparse_index_of_level(0)


def test_store_sparse_index_of_a_changelog_over_many_files(spark, tmp_path, monkeypatch):
    import duckdb
    from changeloom import catalog, catalog_store

    monkeypatch.setattr(catalog_store, "STEPS", Options(flush_keys=None, flush_bytes=None, flush_files=None, compaction=False, file_bytes=500))
    got = [(r.key, r.offset) for r in catalog.queries()["store_sparse_index"](spark, "/root/testdata/sf0.001").collect()]
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    assert sorted(got) == sorted(con.execute(catalog.oracle_sql()["store_sparse_index"]).fetchall())


def test_visit_seek_clear(spark, root):
    s = Store(spark, root, QUIET)
    s.write(rows(spark, [(c, c.upper()) for c in "abcd"]))
    s.delete(b"b")
    seen = []
    assert s.visit(b"a", b"d", lambda k, v: seen.append((k, v))) == 2 and seen == [(b"a", b"A"), (b"c", b"C")]
    assert s.seek(b"b") == (b"c", b"C") and s.seek(b"e") is None
    s.clear()
    assert state(s) == {} and s.last_seq() == 2
    s.put(b"a", b"again")
    assert state(s) == {"a": "again"}


@pytest.mark.parametrize("flush_bytes", [1 << 10, 1 << 14, 1 << 20])
def test_batches_over_flush_sizes(spark, root, flush_bytes):
    """A thousand keys put, deleted and put again, at several flush sizes, with a reopening between."""
    opts = Options(flush_keys=None, flush_bytes=flush_bytes, l0_runs=2)
    keys = [f"key-{i}" for i in range(1024)]
    s = Store(spark, root, opts)
    s.write(rows(spark, [(k, "value") for k in keys]))
    s.write(rows(spark, [(k, None) for k in keys]))
    s = Store(spark, root, opts)
    assert state(s) == {} and s.get(b"key-7") is None
    s.write(rows(spark, [(k, f"again-{k}") for k in keys]))
    assert state(Store(spark, root, opts)) == {k: f"again-{k}" for k in keys} and s.last_seq() == 3


def test_a_dead_writers_lock_ends(spark, root):
    """A writer that is killed while it holds the lock, at any point, stops the others for its lease only."""
    import json
    import time

    opts = Options(flush_keys=None, flush_bytes=None, compaction=False, lease_seconds=1.0, lock_seconds=20.0)
    s = Store(spark, root, opts)
    s.put(b"a", b"1")
    for left in (json.dumps(["dead", time.time() + 1.0]).encode(), b"", b"{"):
        assert s.folder.create_new("LOCK", left)
        s.folder.write(f"manifest-{s.current().number + 1:06d}.json", b"{")
        began = time.monotonic()
        s.put(b"a", b"2")
        assert time.monotonic() - began < 15 and s.get(b"a") == b"2"
        assert s.folder.read("LOCK") is None
    # a lock that is alive is waited for, and not taken
    quick = Store(spark, root, Options(lock_seconds=0.3, lease_seconds=30.0))
    assert s.folder.create_new("LOCK", json.dumps(["alive", time.time() + 60]).encode())
    with pytest.raises(TimeoutError):
        quick.clear()
    assert json.loads(s.folder.read("LOCK"))[0] == "alive"
    s.folder.delete("LOCK")


def test_a_killed_process_leaves_a_usable_store(spark, root, tmp_path):
    """A process that takes the lock and is killed by the system: the next writer goes on."""
    import signal
    import subprocess
    import sys
    import time

    opts = Options(flush_keys=None, flush_bytes=None, compaction=False, lease_seconds=1.5)
    s = Store(spark, root, opts)
    s.put(b"a", b"1")
    code = "import json,sys,time\nopen(sys.argv[1], 'xb').write(json.dumps(['killed', time.time() + 1.5]).encode())\nprint('held', flush=True)\ntime.sleep(600)"
    child = subprocess.Popen([sys.executable, "-c", code, f"{tmp_path}/store/LOCK"], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    while child.stdout.readline().strip() != b"held":
        pass
    child.send_signal(signal.SIGKILL)
    child.wait()
    began = time.monotonic()
    s.put(b"a", b"2")
    assert state(s) == {"a": "2"} and time.monotonic() - began < 20


def test_an_overtaken_commit_takes_the_next_version(spark, root):
    """Data are written before the lock; another commit in between changes the order, not the result."""
    s = Store(spark, root, QUIET)
    files, done = s._files, []

    def slow(*args, **kw):
        out = files(*args, **kw)
        if not done:
            done.append(True)
            Store(spark, root, QUIET).write(rows(spark, [("a", "first"), ("b", "first")]), parts=1)
        return out

    s._files = slow
    assert s.write(rows(spark, [("a", "second")]), parts=1) == 2
    assert state(s) == {"a": "second", "b": "first"}
    assert {bytes(r.key): r.seq for r in s.scan().collect()} == {b"a": 2, b"b": 1}
    s.flush()
    assert state(s) == {"a": "second", "b": "first"} and all(f.seq is None for f in s.current().files)


def test_a_lost_lock_is_found_before_publishing(spark, root):
    s = Store(spark, root, QUIET)
    swap, lost = s.folder.swap, []
    write = s.folder.write

    def steal(name, data, overwrite=True):
        if name.startswith("CURRENT.") and not lost:
            lost.append(True)
            s.folder.delete("LOCK")  # as if its time were over and another writer had ended it
        write(name, data, overwrite)

    s.folder.write = steal
    s.put(b"a", b"1")
    assert lost and s.get(b"a") == b"1" and s.last_seq() == 1 and s.folder.swap == swap


def test_small_commits_are_flushed_by_their_number(spark, root):
    s = Store(spark, root, Options(flush_keys=None, flush_bytes=None, flush_files=3, compaction=False))
    for k in range(7):
        s.put(f"k{k}".encode(), b"v")
    s.wait()
    assert sum(f.level == -1 for f in s.current().files) < 3
    assert len(state(s)) == 7


def test_maintenance_runs_beside_writers(spark, root):
    opts = Options(flush_keys=None, flush_bytes=None, flush_files=2, l0_runs=2, background=True)
    s = Store(spark, root, opts)
    begun, go = threading.Event(), threading.Event()
    maintain = s.maintain

    def slow():
        begun.set()
        go.wait(60)
        maintain()

    s.maintain = slow
    for k in range(6):
        s.put(f"k{k}".encode(), b"v")  # none of these waits for the maintenance
    assert begun.is_set() and all(f.level == -1 for f in s.current().files)
    go.set()
    s.wait()
    assert any(f.level >= 0 for f in s.current().files) and len(state(s)) == 6
    s.maintain = lambda: (_ for _ in ()).throw(OSError("disk"))
    s.put(b"x", b"1"), s.put(b"y", b"2")
    with pytest.raises(OSError, match="disk"):
        s.wait()
    assert s.get(b"y") == b"2"


def test_a_compaction_that_was_overtaken_gives_up(spark, root):
    s = Store(spark, root, QUIET)
    for v in ("1", "2"):
        s.write(rows(spark, [("a", v), ("b", None if v == "2" else v)]), parts=1)
        s.flush()
    files, done = s._files, []

    def slow(*args, **kw):
        out = files(*args, **kw)
        if not done:
            done.append(True)
            Store(spark, root, QUIET).compact(0)
        return out

    s._files = slow
    s.compact(0)
    assert state(s) == {"a": "2"} and len(s.current().files) == 1


def test_vacuum_spares_what_a_writer_has_not_published(spark, root):
    s = Store(spark, root, QUIET)
    s.put(b"a", b"1")
    with s._staging() as name:
        s._files(s.log().withColumn("seq", F.lit(2).cast("long")), -1, 9, 1, name)
        s.vacuum()
        assert name.split("/")[1] in s.folder.list("data")
    s.vacuum()
    assert name.split("/")[1] not in s.folder.list("data") and s.get(b"a") == b"1"
