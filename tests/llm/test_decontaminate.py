import random
import re

import pytest
from changeloom.llm import decontaminate as d
from helpers import UPPER


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))


def brute(docs, items, window=8):
    wins = []
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        wins += [(str(i), tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n]
    out = {}
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for i, g in set(wins):
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found.add(i)
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def case(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "a", "b", "Ce", "é", "x9"])
    items = [(k, " ".join(word() for _ in range(rnd.choice([1, 3, 7, 8, 9, 12, 20])))) for k in range(8)]
    items += [(20, None), (21, "..."), (22, items[0][1].upper()), (23, items[3][1] + " tail")]
    docs = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 30)))]
        if rnd.random() < 0.5:
            parts += [rnd.choice(items)[1] or "", "zz " * rnd.randint(0, 3)]
        rnd.shuffle(parts)
        docs.append((k, "\n".join(parts)))
    return docs + [(100, None), (101, ""), (102, "!?"), (103, docs[0][1])], items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs, items = case(seed)
    if seed == 2:  # no short items: only longer runs are streamed
        items = [i for i in items if len(words(i[1])) >= 8]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_ids int").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in d.find_contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items)


def test_automaton_matches_lengths():
    rnd = random.Random(4)
    items = [(k, [rnd.randint(0, 2) for _ in range(rnd.randint(1, 14))]) for k in range(12)]
    auto = d.SuffixAutomaton(items, 4)
    text = [rnd.randint(0, 3) for _ in range(3000)]
    got = {}
    for i, m, found, n in auto.scan(text):
        got.setdefault((i, m), set()).update(found)
        assert any(text[i - n + 1 : i + 1] == w[k : k + n] for _, w in items for k in range(len(w)))
    want = {}
    for item, w in items:
        m = min(4, len(w))
        for k in range(len(w) - m + 1):
            for i in range(m - 1, len(text)):
                if text[i - m + 1 : i + 1] == w[k : k + m]:
                    want.setdefault((i, m), set()).add(item)
    assert got == want


def test_filter_cuts_and_drops(spark):
    a, b = "one two three four five six seven eight nine", "k1 k2 k3 k4 k5 k6 k7 k8"
    pad = " ".join(f"w{k}" for k in range(30))
    docs = [(1, f"{pad} é {a}. {pad}", 9), (2, f"{pad} {a} {b}", 9), (3, pad, 5), (4, None, 0), (5, b, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    out = d.decontaminate(df, spark.createDataFrame([(1, a), (2, b)], "item_id long, text string"))
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    cut = f"{pad} é . {pad}"
    assert got == {1: (cut, len(cut)), 3: (pad, 5), 4: (None, 0)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert d.find_contamination(docs, items).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert d.find_contamination(one, items).first().n_hit == 0


def test_repeated_and_unnamed_items(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h"), (1, "i j k l m n o p"), (None, "q r s t u v w x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u v w x")], "doc_id long, text string")
    row = d.find_contamination(docs, items).first()
    assert row.item_ids == ["", "1"] and row.n_hit == 24


def test_benchmark_of_several_automata(spark, monkeypatch):
    docs, items = case(3)
    df = spark.createDataFrame([(a, b, len(b or "")) for a, b in [*docs, (None, docs[0][1]), (0, docs[1][1])]], "doc_id long, text string, n_chars int").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    found = lambda: sorted(d.find_contamination(df, table).collect(), key=str)
    left = lambda: sorted(d.decontaminate(df, table).collect(), key=str)
    one = found(), left()
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in one[0] if r.doc_id} == {k: v for k, v in brute(docs, items).items() if k}
    monkeypatch.setattr(d, "MAX_ITEM_WORDS", 8)
    assert len(list(d.item_parts(table))) > 3
    assert (found(), left()) == one
    assert 0 < len(one[1]) < df.count()
