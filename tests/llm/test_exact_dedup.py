from changeloom.llm import exact_dedup, storage


def test_groups_nulls_and_prefixes(spark, monkeypatch):
    long = "x" * 500
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "A"), (6, long + "p"), (7, long + "q"), (8, long + "p"), (9, "b"), (12, "a"), (13, " a")]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, size int, keep_id string").repartition(3)
    want = {}
    for d, t in rows:
        same = [e for e, u in rows if (u or "") == (t or "")]
        want[d] = (max(same), len(same), d == max(same))
    for most, hot in ((250_000, 1000), (0, 1000), (250_000, 3)):
        monkeypatch.setattr(storage, "BROADCAST_KEYS", most)
        monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df).collect()}
        assert got == want
    kept = exact_dedup.exact_duplicate_filter(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d in want if want[d][2]}


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (None, "a"), (None, "z"), (None, "z"), (3, "c"), (3, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df).collect()), key=str)
    want = [(1, 1, 3, True), (1, 1, 3, True), (1, 2, 2, False), (2, 2, 2, True), (0, 1, 3, False), (0, 0, 2, None), (0, 0, 2, None), (3, 3, 2, True), (3, 3, 2, True)]
    assert got == sorted(want, key=str)
    left = sorted(((r.doc_id or 0, r.text) for r in exact_dedup.exact_duplicate_filter(df).collect()))
    assert left == [(0, "a"), (0, "z"), (0, "z"), (1, "a"), (1, "a"), (2, "b"), (3, "c"), (3, "c")]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(df).collect() == []
