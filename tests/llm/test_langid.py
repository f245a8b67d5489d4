import random
from zlib import crc32

import numpy as np
from changeloom.llm import langid


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    got = langid.predict_languages(docs)
    assert got.count() == docs.count()
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_windows_cover_whole_texts():
    parts = [b"a" * 700, b"", b"xyz", bytes(range(1, 256)) + b"q"]
    data = np.frombuffer(b"".join(parts), np.uint8)
    offs = np.cumsum([0, *map(len, parts)])
    w, filled, first = langid.cut_windows(data, offs)
    for k, p in enumerate(parts):
        own = w[first[k] : first[k + 1]]
        assert b"".join(x.tobytes()[:n] for x, n in zip(own, filled[first[k] : first[k + 1]], strict=True)) == p


def test_pooling_equals_plain_convolution():
    rng = np.random.default_rng(1)
    net = langid.ByteConvNet(["a", "b"])
    w = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    got = net.pooled(w)
    for i in range(3):
        want = []
        for width, f, s in zip(langid.WIDTHS, net.filters, net.shift, strict=True):
            y = [sum(net.embed[w[i, p + k]] @ f[k] for k in range(width)) for p in range(langid.WINDOW - width + 1)]
            want.append(np.maximum(np.max(y, 0) + s, 0))
        assert np.allclose(got[i], np.concatenate(want), atol=1e-4)


def test_gradient():
    """Every parameter's gradient against differences of the loss, in double precision."""
    rng = np.random.default_rng(2)
    net = langid.ByteConvNet(["a", "b", "c"])
    net.embed, net.shift, net.out, net.bias = (p.astype(float) for p in (net.embed, net.shift, net.out, net.bias))
    net.filters = [f.astype(float) for f in net.filters]
    x, y = rng.integers(0, 256, (8, langid.WINDOW)).astype(np.uint8), rng.integers(0, 3, 8)
    loss = lambda: -np.mean(net.log_probabilities(x)[np.arange(8), y])
    for param, grad in zip(net.params(), net.gradients(x, y), strict=True):
        at = np.argsort(-np.abs(grad).ravel())[:5].tolist() + rng.integers(0, grad.size, 5).tolist()
        for i in at:
            old = param.flat[i]
            param.flat[i] = old + 1e-6
            up = loss()
            param.flat[i] = old - 1e-6
            down = loss()
            param.flat[i] = old
            assert abs((up - down) / 2e-6 - grad.flat[i]) < 1e-5
    net = langid.ByteConvNet(["a", "b", "c"])
    before = loss()
    net.fit(x, y, epochs=12, batch=8)
    assert loss() < before


def rows_of_two():
    rnd = random.Random(9)
    words = {"en": ["the", "cat", "and", "dog", "sat", "with", "house"], "de": ["der", "hund", "und", "katze", "größe", "mit", "haus"]}
    return [(k, " ".join(rnd.choice(words[v]) for _ in range(rnd.randint(1, 160))), v) for k in range(60) for v in ("en", "de")[k % 2 : k % 2 + 1]]


def test_against_brute_force(spark):
    """The whole query: the learned network applied in plain loops, window by window."""
    rows = [*rows_of_two(), (200, "42 !", "en"), (201, None, "de"), (202, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in langid.predict_languages(df).collect()}
    net = langid.train(df)
    assert net.languages == ["de", "en"] and len(got) == len(rows)
    for d, text, _ in rows:
        assert got[d].held_out == (crc32(str(d).encode()) % 5 == 0)
        if not any(c.isalpha() for c in text or ""):
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        data, total = text.encode(), np.zeros(2)
        for i in range(0, len(data), langid.WINDOW):
            w = data[i : i + langid.WINDOW]
            padded = w + bytes(langid.WINDOW - len(w))
            top = []
            for width, f, s in zip(langid.WIDTHS, net.filters, net.shift, strict=True):
                y = [sum(net.embed[padded[p + k]].astype(float) @ f[k] for k in range(width)) for p in range(langid.WINDOW - width + 1)]
                top += np.maximum(np.max(y, 0) + s, 0).tolist()
            z = np.array(top) @ net.out + net.bias
            total += len(w) * (z - np.log(np.exp(z).sum()))
        p = np.exp(total / len(data))
        p /= p.sum()
        assert got[d].lang_pred == net.languages[int(p.argmax())] and abs(got[d].score - p.max()) < 1e-4


def test_held_out_rows_teach_nothing(spark):
    rows = rows_of_two()
    wrong = [(d, t, "xx" if crc32(str(d).encode()) % 5 == 0 else v) for d, t, v in rows]
    a, b = (langid.predict_languages(spark.createDataFrame(r, "doc_id long, text string, lang string")).collect() for r in (rows, wrong))
    assert sorted(a) == sorted(b)


def test_odd_inputs(spark):
    rows = [(k, "the cat and the dog " * 20, "en") for k in range(40)] + [(100 + k, "der hund und die katze " * 20, "de") for k in range(40)]
    rows += [(300, None, "en"), (301, "", "de"), (302, "12 34 !!", "en"), (303, "the cat and the dog", None), (304, "der hund " * 40000, "de")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double").repartition(3)
    got = {r.doc_id: r for r in langid.predict_languages(df).collect()}
    assert len(got) == len(rows)
    assert [got[k].lang_pred for k in (300, 301, 302)] == ["und"] * 3
    assert got[303].lang_pred == "en" and got[304].lang_pred == "de"
    none = df.withColumn("lang", df.lang.cast("string")).where("doc_id = 303")
    assert langid.predict_languages(none).first().lang_pred == "und"
    assert langid.predict_languages(df.limit(0)).collect() == []
