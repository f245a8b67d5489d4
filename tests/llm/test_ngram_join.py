import random

from changeloom.llm import components as parts
from changeloom.llm import ngram_join, storage
from helpers import components


def result(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.ngram_components(df, **kw).collect()
    assert len(got) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


def near_copies(seed=7, groups=((60, 40), (150, 30), (40, 5), (30, 2)), alone=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 4)))
    passage = [word() for _ in range(30)]
    rows = []
    for length, copies in groups:
        base = [word() for _ in range(length)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, length // 35))):
                w[rnd.randrange(len(w))] = word()
            rows.append(" ".join(w))
    for _ in range(alone):
        rows.append(" ".join([word() for _ in range(rnd.randint(1, 30))] + passage))
    rows += [None, "", " \t\n", "a", "A", "a b c d", "A B c d", "a b c d e", "x y z", rows[0], rows[0].upper()]
    rnd.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_against_brute_force(spark):
    rows = near_copies()
    assert result(spark, rows) == components(rows)


def test_large_groups_small_blocks(spark, monkeypatch):
    """Groups far over FEW and over BLOCK take the hub and the block comparison."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rows = near_copies(3, ((150, 90), (200, 60)), 5)
    assert result(spark, rows) == components(rows)


def test_shared_entries_meet_their_hub_by_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(storage, "HOT_ROWS", 3)
    rows = near_copies(11, ((80, 50), (60, 30)), 10)
    assert result(spark, rows) == components(rows)
    monkeypatch.setattr(storage, "BROADCAST_KEYS", 1)
    assert result(spark, rows) == components(rows)


def test_frequent_words_make_no_candidates(spark):
    """Texts of common words and a few own ones: no entry of the index is shared, whatever the number of texts."""
    import numpy as np

    rows = [(k, " ".join([f"c{i}" for i in range(10)] + [f"own{k}x{i}" for i in range(4)])) for k in range(400)]
    assert set(result(spark, rows).values()) == {(10, k) for k in range(400)}
    from changeloom.llm.storage import Workspace
    from changeloom.llm.textbytes import arrow_texts, shingle_sets

    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = ngram_join.order_table(spark, Workspace(spark, "order"), df, 4000, 5)
    keys = []
    for s in shingle_sets(*arrow_texts(df.select("text").toArrow().column("text")), 5):
        keys += [*ngram_join._index_keys(s, *table, 4, 5)]
    _, times = np.unique(np.concatenate(keys), return_counts=True)
    assert times.max() <= 2


def test_order_table_too_small(spark, monkeypatch):
    """Tokens that the bounded order table has no room for count as rare; the links stay the same."""
    monkeypatch.setattr(ngram_join, "TABLE_TOKENS", 4)
    rows = near_copies(5, ((80, 40), (60, 20)), 5)
    assert result(spark, rows) == components(rows)


def test_empty_table_and_extra_columns(spark):
    assert result(spark, []) == {}
    df = spark.createDataFrame([(1, "a b c d e f", 5, 9), (2, "a b c d e f", 6, 9)], "doc_id long, text string, node int, component_id int")
    got = {tuple(r) for r in ngram_join.ngram_components(df).collect()}
    assert got == {(1, 2, 1), (2, 2, 1)}
    assert [tuple(r) for r in ngram_join.near_duplicate_filter(df).collect()] == [(1, "a b c d e f", 5, 9)]


def test_sample_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect()}
    assert got == components(rows)


def test_repeated_and_missing_ids(spark):
    a, b = "a b c d e f g", "h i j k l m n"
    rows = [(1, a), (1, a), (None, a), (None, b), (None, None), (2, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (0, 3, 1), (0, 3, None), (0, 0, None), (2, 3, 1)], key=str)
    assert sorted((r.doc_id or 0) for r in ngram_join.near_duplicate_filter(df).collect()) == [0, 0, 0, 1, 1]


def test_every_token_is_counted(spark):
    from collections import Counter

    import numpy as np
    from changeloom.llm.storage import Workspace
    from changeloom.llm.textbytes import arrow_texts, shingle_sets

    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {tuple(s.tolist()) for s in shingle_sets(*arrow_texts(df.select("text").toArrow().column("text")), 5)}
    df_of = Counter(t for s in sets if len(s) >= 4 for t in s)
    # one task: equal sets are counted once in each
    tokens, classes = ngram_join.order_table(spark, Workspace(spark, "order"), df.coalesce(1), sum(map(len, sets)), 5)
    want = {t: n.bit_length() for t, n in df_of.items() if n > 2}
    assert dict(zip(tokens.tolist(), classes.tolist(), strict=True)) == want
    # frequent ones are in combinations only, whatever their hash
    often = tokens[classes >= ngram_join._CLASS_F]
    assert len(often) > 50
    for s in sets:
        if len(s) >= 4:
            singles, _ = ngram_join._index_keys(np.array(s, np.uint64), tokens, classes, 4, 5)
            assert not np.isin(singles, often).any()


def test_bitmaps_rule_out_no_link():
    """Bounds by bitmaps of one and of two widths, against true similarities."""
    import numpy as np

    rnd = np.random.default_rng(5)
    row = lambda s: np.frombuffer(ngram_join.parity_bits(s), np.uint64)[None]
    kept = linked = apart = 0
    for size in (4, 40, 64, 70, 130, 1000, 1100, 5000):
        for share in (1.0, 0.95, 0.9, 0.89, 0.85, 0.5, 0.0):
            for less in (1.0, 0.9, 0.8):
                tokens = rnd.integers(0, 1 << 64, 2 * size, dtype=np.uint64)
                a, both = tokens[:size], int(size * min(share, less))
                b = np.concatenate([a[:both], tokens[size : size + max(1, int(size * less)) - both]])
                links = 5 * both >= 4 * (len(a) + len(b) - both)
                for x, y in ((a, b), (b, a)):
                    may = ngram_join.may_link(np.array([len(x)]), row(x), np.array([len(y)]), row(y), 4, 5)[0]
                    assert may or not links
                    kept += may and not links
                    linked += links
                    apart += share <= 0.5 and size >= 64
                    assert not (may and share <= 0.5 and size >= 64)
    assert linked > 50 and apart > 50 and kept > 0


def test_only_likely_sets_are_written_whole(spark, monkeypatch):
    """Sets that share index entries but are not alike are compared by their bitmaps."""
    rnd = random.Random(4)
    common = [[f"c{k}w{i}" for i in range(30)] for k in range(20)]
    rows = []
    for k in range(120):
        words = [f"group{k // 6}x{i}" for i in range(12)]
        for passage in rnd.sample(common, 3):
            words += passage
        rows.append((k, " ".join(words)))
    rows += [(200, rows[7][1] + " more"), (201, rows[50][1] + " words")]
    want, written = components(rows), {}
    assert len(set(c for _, c in want.values())) > 110
    write = storage.Workspace.write

    def counting(self, df, name, *more):
        out = write(self, df, name, *more)
        written[name] = out.count()
        return out

    monkeypatch.setattr(storage.Workspace, "write", counting)
    assert result(spark, rows) == want
    assert written["pairs"] > 200
    in_links = [d for d, (_, c) in want.items() if sum(c == o for _, o in want.values()) > 1]
    assert len(in_links) <= written["sets"] + written.get("block-sets", 0) <= 2 * len(in_links) + 4


def test_shuffle_files_go_with_their_step(spark):
    """What a step shuffles is no longer on disk when the next ones run."""
    import re
    import time

    from pyspark.sql import functions as F

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", found))

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(key)
    rows = spark.range(20_000).withColumn("k", F.col("id") % 1000)
    work = storage.Workspace(spark, "shuffles")
    got = work.write(rows.groupBy("k").agg(F.collect_list("id").alias("ids")), "lists")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert got.count() == 1000 and spark.conf.get(key) == setting
    work.drop()


def test_few_edges_take_few_jobs(spark, monkeypatch):
    """Both ways give the least node reachable, and few edges do not take the driver's memory for many stages."""
    rnd = random.Random(5)
    edges = [(k + 1, k) for k in range(100, 140)] + [(-7, k) for k in range(200, 260)] + [(500, 500), (1 << 40, -(1 << 40))]
    edges += [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(180)]
    rnd.shuffle(edges)
    least = {n: n for e in edges if e[0] != e[1] for n in e}
    while any(least[a] != least[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    work, context = storage.Workspace(spark, "edges"), spark.sparkContext
    written = work.write(spark.createDataFrame(edges * 2, "a long, b long").repartition(5), "edges")
    none = work.write(written.where("a is null"), "none")
    tracker, jobs = context.statusTracker(), {}
    for way in ("one task", "steps"):
        if way == "steps":
            monkeypatch.setattr(parts, "ONE_TASK_EDGES", 3)
        context.setJobGroup(way, way)
        got = parts.connected_components(written, work, way.split()[0]).collect()
        jobs[way] = len(tracker.getJobIdsForGroup(way))
        context.setJobGroup("rest", "rest")
        assert len(got) == len(least) and {r.node: r.component for r in got} == least
        assert parts.connected_components(none, work, f"{way.split()[0]}-none").count() == 0
        assert jobs["one task"] <= 6
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs["steps"] > 6
    work.drop()


def test_components_by_steps(spark, monkeypatch):
    """Whole joins where the edges are too many for one task."""
    monkeypatch.setattr(parts, "ONE_TASK_EDGES", 3)
    rows = near_copies(13, ((80, 40), (60, 30)), 10)
    assert result(spark, rows) == components(rows)


def test_chance_entries_do_not_make_a_large_cluster(spark, monkeypatch):
    """Entries that hang together through texts of several common passages are compared one by one, not each text with all."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rnd = random.Random(9)
    passages = [[f"p{k}w{i}" for i in range(30)] for k in range(120)]
    rows = [(k, " ".join(w for p in rnd.sample(passages, 4) for w in p)) for k in range(600)]
    rows += [(700 + k, rows[k * 50][1] + " more words") for k in range(10)]
    want, compared, make = components(rows), spark.sparkContext.accumulator(0), ngram_join._candidates_of_blocks

    def counting(*similarity):
        run = make(*similarity)

        def go(table):
            compared.add(table.num_rows)
            return run(table)

        return go

    monkeypatch.setattr(ngram_join, "_candidates_of_blocks", counting)
    assert result(spark, rows) == want
    assert 0 < compared.value < 20 * len(rows)
