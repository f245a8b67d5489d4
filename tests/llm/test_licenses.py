import random
import re

import numpy as np
import pyarrow as pa
from changeloom.llm import licenses
from changeloom.llm.textbytes import arrow_texts

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def grams(text):
    w = re.findall(WORDS, (text or "").lower())
    return [tuple(w[k : k + 2]) for k in range(len(w) - 1)]


def brute(text):
    """Templates contained in a window of any text block pair, without MinHash."""
    g, out = grams(text), {}
    for k, (_, t) in enumerate(licenses.TEMPLATES):
        want = set(grams(t))
        size = max(4, 1 << (len(want and grams(t)) + 1 - 1).bit_length())
        for i in range(0, len(g), size):
            share = len(want & set(g[i : i + 2 * size])) / len(want)
            if share >= licenses.LEAST:
                out[k] = max(share, out.get(k, 0))
    return sorted(out.items())


def texts(seed=3, n=150):
    rnd = random.Random(seed)
    out = [None, "", "MIT", "All rights", "ALL RIGHTS RESERVED", *(t for _, t in licenses.TEMPLATES)]
    for _ in range(n):
        parts = [" ".join(rnd.choice(["the", "license", "version", "rights", "free", "é", "of"]) for _ in range(rnd.randint(0, 70))) for _ in range(3)]
        t = rnd.choice(licenses.TEMPLATES)[1]
        if rnd.random() < 0.3:  # a changed word
            w = t.split()
            w[rnd.randrange(len(w))] = "changed"
            t = " ".join(w)
        parts.insert(rnd.randint(0, 3), rnd.choice([t, t.upper(), t.replace(" ", "\n  * "), ""]))
        out.append(". ".join(parts))
    return out


def test_against_brute_force():
    every = texts()
    got = list(licenses.Scanner().scan(*arrow_texts(pa.array(every, pa.string()))))
    for t, found in zip(every, got, strict=True):
        assert [k for k, _ in found] == [k for k, _ in brute(t)], t
        assert np.allclose([s for _, s in found], [s for _, s in brute(t)])


def test_operator(spark):
    every = texts(5, 20)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(every)], "doc_id long, text string, matches string").repartition(3)
    got = {r.doc_id: [m.license for m in r.matches] for r in licenses.scan_licenses(df).collect()}
    assert got == {k: [licenses.TEMPLATES[i][0] for i, _ in brute(t)] for k, t in enumerate(every)}
    assert licenses.scan_licenses(df.limit(0)).collect() == []
