import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from changeloom.llm import toxicity
from changeloom.llm.textbytes import arrow_texts


def sets(texts):
    return list(toxicity.word_sets(*arrow_texts(pa.array(texts, pa.string()))))


#: Invented words, of two kinds that mostly do not meet in a text.
BAD = [["grubzak", "vornik", "blathul"], ["smerkin", "drozzle", "yaffbag"]]


def corpus(n=600, seed=1):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        w = [rnd.choice(["sun", "rain", "tree", "house", "walk", "talk", "green"]) + rnd.choice(["", "s", "ing"]) for _ in range(rnd.randint(5, 60))]
        toxic = k % 4 == 0
        if toxic:
            kind = BAD[(k // 4) % 2]
            w[2] = rnd.choice(kind).upper()
            w[4] = rnd.choice(kind if rnd.random() < 0.9 else BAD[1 - (k // 4) % 2]) + "!"
        rows.append((k, " ".join(w), int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows], "doc_id long, text string, toxic string").repartition(3)
    return docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")


def held_out(doc_id):
    return crc32(str(doc_id).encode()) % 4 == 2


def test_held_out(spark):
    """Only rows that no model has seen count, and their labels do not matter."""
    rows = corpus()
    docs, labels = frames(spark, rows)
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    apart = [(d, y) for d, _, y in rows if held_out(d)]
    assert len(apart) > 100
    assert np.mean([got[d].toxic == y for d, y in apart]) > 0.98
    _, wrong = frames(spark, [(d, t, 1 - y if held_out(d) else y) for d, t, y in rows])
    assert {r.doc_id: r for r in toxicity.classify(docs, wrong).collect()} == got


def test_held_out_sample(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.classify(docs, labels).withColumnRenamed("toxic", "found")
    rows = [r for r in found.join(labels, "doc_id").collect() if held_out(r.doc_id) and r.toxic is not None]
    clean = [r.found for r in rows if r.toxic == 0]
    assert len(clean) > 20 and np.mean(clean) < 0.05


def test_kinds_are_found_in_the_data():
    rows = corpus()
    table, toxic = toxicity.Table(sets([t for _, t, _ in rows])), np.array([y for *_, y in rows], bool)
    kinds = table.kinds(toxic)
    assert not kinds[~toxic].any() and (kinds[toxic].sum(1) == 1).all()
    pure = np.array([i for i, (_, t, y) in enumerate(rows) if y and sum(any(w in t.lower() for w in bad) for bad in BAD) == 1])
    truth = np.array([any(w in rows[i][1].lower() for w in BAD[0]) for i in pure])
    first = kinds[pure, 0] == 1
    assert max(np.mean(first == truth), np.mean(first != truth)) > 0.9


def brute(rows):
    """The whole query in plain Python: sets of strings, shares by counting, models in double precision by small damped steps."""
    def features(t):
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
        return set(words) | {(n, w.encode()[:n]) for w in words for n in toxicity.STEMS if len(w.encode()) > n}

    every = {d: features(t) for d, t, _ in rows}
    train = sorted((d, y) for d, _, y in rows if not held_out(d))
    count = {}
    for d, _ in train:
        for f in every[d]:
            count[f] = count.get(f, 0) + 1
    known = {f for f, c in count.items() if c > 2}

    def telling(y, ids):
        n1 = max(1, sum(y[d] for d in ids))
        n0 = max(1, sum(1 - y[d] for d in ids))
        out = []
        for f in known:
            c1, c0 = sum(y[d] for d in ids if f in every[d]), sum(1 - y[d] for d in ids if f in every[d])
            both = (c1 + c0) / (n1 + n0)
            z = (c1 / n1 - c0 / n0) / (max(both * (1 - both), 1e-9) * (1 / n1 + 1 / n0)) ** 0.5
            ratio = (c1 / n1 + 1e-6) / (c0 / n0 + 1e-6)
            if abs(z) >= toxicity.LEAST_Z and max(ratio, 1 / ratio) >= toxicity.LEAST_RATIO:
                out.append((f, z))
        return out

    def fit(more, y, ids):
        chosen = [f for f, _ in telling(y, ids)]
        row = lambda d: [float(f in every[d]) for f in chosen] + more.get(d, []) + [1.0]
        x, goal = np.array([row(d) for d in ids]), np.array([y[d] for d in ids], float)
        w, ridge = np.zeros(x.shape[1]), np.ones(x.shape[1])
        ridge[-1] = 1e-6
        for _ in range(400):
            p = 1 / (1 + np.exp(-x @ w))
            w += 0.5 * np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (goal - p) - ridge * w)
        return lambda d, extra: 1 / (1 + np.exp(-np.dot([float(f in every[d]) for f in chosen] + extra + [1.0], w)))

    return every, train, telling, fit


def test_against_brute_force(spark):
    rows = corpus(320, 5)
    docs, labels = frames(spark, rows)
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    every, train, telling, fit = brute(rows)
    ids, toxic = [d for d, _ in train], dict(train)
    # the kinds are taken as they are (tested above); shares, models, folds and the chain are done again
    texts = {d: t for d, t, _ in rows}
    kinds = toxicity.Table(sets([texts[d] for d in ids])).kinds(np.array([toxic[d] for d in ids], bool))
    labels_of = [{d: int(kinds[i, k]) for i, d in enumerate(ids)} for k in range(toxicity.KINDS)] + [toxic]
    fold = {d: crc32(b"fold" + str(d).encode()) % toxicity.FOLDS for d in ids}
    models, more = [], {d: [] for d in ids}
    for k, y in enumerate(labels_of):
        models.append(fit(more, y, ids))
        if k + 1 < len(labels_of):
            apart = {f: fit(more, y, [d for d in ids if fold[d] != f]) for f in set(fold.values())}
            more = {d: [*more[d], float(apart[fold[d]](d, more[d]))] for d in ids}
    for d, _, _ in rows:
        p = []
        for m in models:
            p.append(float(m(d, p)))
        want = [got[d][f"p_{c}"] for c in toxicity.CATEGORIES]
        assert p == pytest.approx(want, abs=2e-3), d
        assert got[d].toxic == int(p[-1] >= toxicity.THRESHOLD) or abs(p[-1] - toxicity.THRESHOLD) < 2e-3


def test_chain_uses_out_of_fold_predictions():
    """The second model's extra input in training is what models without the text's fold give."""
    rows = corpus(300)
    s, toxic = sets([t for _, t, _ in rows]), np.array([y for *_, y in rows])
    first = np.array([y and b"vornik" in t.lower().encode() for _, t, y in rows]).astype(int)
    fold = np.arange(len(s)) % toxicity.FOLDS
    chain = toxicity.fit_chain(s, toxic, fold, first[:, None])
    assert len(chain.models) == 2 and chain.models[1].extra.shape == (1,)
    own, none = np.zeros((len(s), 1)), np.zeros((len(s), 0))
    table = toxicity.Table(s)
    for f in range(toxicity.FOLDS):
        m = table.fit(none, first.astype(float), fold != f)
        for i in np.flatnonzero(fold == f):
            own[i, 0] = toxicity.Chain([m]).predict([s[i]])[0, 0]
    again = table.fit(own, toxic.astype(float), np.ones(len(s), bool))
    assert np.allclose(again.weights, chain.models[1].weights) and np.allclose(again.extra, chain.models[1].extra)


def test_fit_converges_or_fails(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.hstack([rng.random((200, 5)) < 0.4, np.ones((200, 1))]).astype(np.float32)
    y = (x[:, 0] > 0).astype(float)
    w = toxicity.ridge(x, y)
    p = 1 / (1 + np.exp(-x.astype(float) @ w))
    penalty = np.array([1.0] * 5 + [1e-6])
    assert np.abs(x.T @ (y - p) - penalty * w).max() < 1e-3  # the gradient is gone
    monkeypatch.setattr(toxicity, "MOST_STEPS", 2)
    with pytest.raises(RuntimeError, match="converge"):
        toxicity.ridge(x, y)


def test_training_bytes_are_bounded(spark):
    from changeloom.llm.sampling import within_bytes

    rows = [(k, "x" * (100 if k else 100_000), k % 2) for k in range(50)] + [(2, "y" * 100, 0)] * 40
    texts = spark.createDataFrame([(d, t) for d, t, _ in rows], "of long, text string")
    sample = spark.createDataFrame(sorted({(d, y) for d, _, y in rows}), "of long, label int")
    some = within_bytes(texts, sample, 2, 2000).collect()
    assert [sum(r.label == y for r in some) for y in (0, 1)] == [10, 10]
    assert not {0, 2} & {r.of for r in some}  # a long text, and an id with many rows
    assert within_bytes(texts, sample, 2, 1 << 20).count() == 50
    assert within_bytes(texts.limit(0), sample, 2, 1 << 20).count() == 0


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "idiot " * 30000), (4, "idiot " * 30000)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    assert {r.doc_id: (r.p_toxic, r.toxic) for r in toxicity.classify(docs, none).collect()} == {k: (0.0, 0) for k in (1, 2, 3, 4)}
    one = spark.createDataFrame([(3, 1), (4, 0), (1, 0)], "doc_id long, toxic int")
    assert toxicity.classify(docs, one).count() == 4
    assert toxicity.classify(docs.limit(0), one).count() == 0
