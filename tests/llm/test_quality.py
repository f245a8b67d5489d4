import random
import re
from zlib import crc32

import numpy as np
import pytest
from changeloom.llm import quality
from changeloom.llm.textbytes import span_hashes
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def frames(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels


def test_held_out_accuracy(frames):
    docs, labels = frames
    got = quality.classify(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == docs.count()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = np.mean([[g > b for b in bad] for g in good])
    assert auc > 0.97
    assert np.mean([s >= 0.7 for s in good]) > 0.97 and np.mean([s < 0.7 for s in bad]) > 0.75


def test_scores_are_mean_weights():
    """The scorer against a sum over each text by itself, whatever stands beside it in a batch."""
    import pyarrow as pa
    from changeloom.llm.textbytes import arrow_texts

    rnd = random.Random(2)
    texts = ["", "a", "ab cd", "é" * 5, None] + ["".join(rnd.choice("ab C#é1\n") for _ in range(rnd.randint(0, 90))) for _ in range(50)]
    model = quality.QualityModel(np.random.default_rng(1).normal(size=1 << quality.BITS), 0.3)
    together = model.score(*arrow_texts(pa.array(texts, pa.string())))
    for t, s in zip(texts, together, strict=True):
        data, offs = arrow_texts(pa.array([t], pa.string()))
        rows = np.concatenate([r for r, _ in quality.features(data, offs)])
        mean = model.weights[rows].astype(float).sum() / max(1, len(rows))
        assert s == pytest.approx(1 / (1 + np.exp(-(0.3 + mean))), abs=1e-6)


def test_filter_and_odd_inputs(spark, frames):
    docs, labels = frames
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want
    odd = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (3, "x " * 50000, 3.0)], "doc_id long, text string, score double")
    assert {r.doc_id: 0 <= r.score <= 1 for r in quality.classify(odd, labels).collect()} == {1: True, 2: True, 3: True}
    # nothing to learn from; nothing to score
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert [r.score for r in quality.classify(odd.where("doc_id = 3"), none).collect()] == [0.5]
    assert quality.classify(odd.limit(0), labels).count() == 0


def test_repeatable(frames):
    docs, labels = frames
    a, b = (quality.train(d, labels) for d in (docs, docs.repartition(5, F.col("doc_id"))))
    assert np.array_equal(a.weights, b.weights)


def plain_features(text):
    """Rows of the table that a text's words, shapes and byte n-grams fall on, one by one."""
    data, rows = (text or "").encode(), []
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    fold = lambda h: (h % (1 << 64)) >> (64 - quality.BITS)
    for i, w in enumerate(words):
        raw = np.frombuffer(w, np.uint8)
        rows.append(fold(int(span_hashes(raw, np.array([0]), np.array([len(w)]))[0])))
        upper, digit = sum(65 <= c < 91 for c in w), sum(48 <= c < 58 for c in w)
        other = len(w) - upper - digit - sum(97 <= c < 123 or c >= 128 for c in w)
        quarter = lambda n: min(3, 4 * n // len(w))
        shape = (((quarter(other) * 4 + quarter(upper)) * 4 + quarter(digit)) * 2 + (i > 0 and w == words[i - 1])) * 16 + min(15, len(w))
        rows += [fold((shape + 1) * 0x9E3779B97F4A7C15), fold(((shape >> 4) + 5000) * 0x9E3779B97F4A7C15)]
    for n in (3, 4):
        for i in range(len(data) - n + 1):
            h = 0
            for c in data[i : i + n]:
                h = (h ^ c) * (0x01000193 + 2 * n) % (1 << 32)
            rows.append(((h ^ h >> 15) * 0x2C1B3C6D % (1 << 32)) >> (32 - quality.BITS))
    return rows


def plain_fit(examples, prior):
    """The same steps text by text and row by row, in double precision."""
    rng, size = np.random.default_rng(11), 1 << quality.BITS
    table = ((rng.random((size, quality.DIM), np.float32) - 0.5) / quality.DIM).astype(float)
    out, bias = np.zeros((quality.DIM, 2)), np.zeros(2)
    seen_t, seen_o, rate = {}, np.full(out.shape, 1e-2), 0.6
    for _ in range(quality.EPOCHS):
        order = rng.permutation(len(examples))
        for i in range(0, len(order), 32):
            g_out, g_bias, g_rows = np.zeros(out.shape), np.zeros(2), {}
            for k in order[i : i + 32]:
                y, rows = examples[k]
                vec = sum((table[r] for r in rows), np.zeros(quality.DIM)) / max(1, len(rows))
                p = np.exp(vec @ out + bias)
                p /= p.sum()
                p[y] -= 1
                g_out += np.outer(vec, p)
                g_bias += p
                for r in rows:
                    g_rows[r] = g_rows.get(r, 0) + out @ p / len(rows)
            seen_o += g_out**2
            bias -= rate * 0.02 * g_bias
            for r, g in g_rows.items():
                seen_t[r] = seen_t.get(r, 1e-4) + (g**2).mean()
                table[r] -= rate * g / np.sqrt(seen_t[r]) * 0.2
            if not out.any():
                out += rng.normal(0, 0.3, out.shape)
            out -= rate * g_out / np.sqrt(seen_o) * 0.2
        rate *= 0.7
    share = np.mean([y for y, _ in examples])
    return table @ (out[:, 1] - out[:, 0]), bias[1] - bias[0] + np.log(prior / (1 - prior)) - np.log(share / (1 - share))


def test_against_brute_force(spark):
    """The whole query: features, training and scores done again in plain Python."""
    rnd = random.Random(6)
    good, bad = ["river", "stone", "walks", "under", "Evening", "light"], ["BUY", "$$$", "now!!", "4U", "xxx", "now!!"]
    rows = [(k, " ".join(rnd.choice(good if (k % 3 > 0) == (rnd.random() < 0.9) else bad) for _ in range(rnd.randint(3, 25))), int(k % 3 > 0)) for k in range(70)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    learned = [(y, plain_features(t)) for d, t, y in rows if crc32(str(d).encode()) % 4 != 2]

    def place(example):
        ids = np.unique(np.array(example[1])).astype(np.int32)
        return example[0], crc32(ids.tobytes()), len(ids)

    weights, bias = plain_fit(sorted(learned, key=place), np.mean([y for y, _ in learned]))
    for d, t in [*((d, t) for d, t, _ in rows), (900, None), (901, "")]:
        own = plain_features(t)
        want = 1 / (1 + np.exp(-(bias + sum(weights[r] for r in own) / max(1, len(own)))))
        assert got[d].score == pytest.approx(want, abs=5e-3), d
        assert got[d].held_out == (crc32(str(d).encode()) % 4 == 2)
        assert got[d].predicted == int(want >= 0.7) or abs(want - 0.7) < 5e-3
