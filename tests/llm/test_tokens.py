import random
import zlib

import numpy as np
import public_tokenizers
from changeloom.llm import bpe, huffman, token_files
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello WORLD’s <|endoftext|>foo it's we'll 123 !!??", "ΑΣ ΣΑΣ ΟΔΟΣ", "İstanbul İ'x", "<|ENDOFTEXT|> <|startoftext|><|endoftext|>", "a\x1cb \x0b c\x85d\te\r\nf", "é ́x é",
    "aaaaaaaaaaaaaaaa" * 300, "####" * 2000, "the" * 3000, "don't 're THE'S a.b,c ...,, x-y", "中文 テスト, 한국어!", "", " ", "a", "\n\n",
]


def noise(n, seed=5):
    rnd = random.Random(seed)
    pick = lambda: chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x80, 0x500), rnd.randrange(0x1E00, 0x2100), 32, 39]))
    return ["".join(pick() for _ in range(rnd.randrange(1, 80))) for _ in range(n)]


def library(texts):
    tok = Tokenizer.from_file(PATH)
    ids = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    return ids, [tok.decode(i, skip_special_tokens=False) for i in ids]


def test_bpe_equals_library():
    texts = TEXTS + noise(3000) + [chr(c) + "a" + chr(c) + "!" + chr(c) + "1" for c in range(0x20, 0x3400)]
    own = bpe.WordBpe(PATH)
    ids, offs = own.encode(texts)
    want, decoded = library(texts)
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == want
    assert [d.decode() for d in own.decode(ids, offs)] == decoded


def test_rounds_equal_heap():
    own, rnd = bpe.WordBpe(PATH), random.Random(3)
    words = ["".join(rnd.choice("abctheinr") for _ in range(rnd.randint(1, 60))).encode() for _ in range(300)]
    flat, count = own.merge_words(words)
    heap = [own._heap([*own.first[list(w[:-1])].tolist(), int(own.last[w[-1]])]) for w in words]
    assert flat.tolist() == [i for h in heap for i in h] and count.tolist() == [len(h) for h in heap]


def test_bpe_operator(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate([*TEXTS, None])]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode_decode(df, PATH).collect()}
    want = library([t or "" for _, t in rows])
    assert got == {k: (want[0][k], want[1][k]) for k, _ in rows}
    assert bpe.encode_decode(df.limit(0), PATH).collect() == []


def test_huffman_round_trip():
    rnd = np.random.default_rng(1)
    for n, skew in ((1, 1), (2, 1), (5, 3), (300, 2), (40000, 1.3)):
        ids = np.minimum(rnd.zipf(skew + 0.01, 20000) if skew > 1 else rnd.integers(0, n, 500), n) - (skew > 1)
        ids = np.clip(ids, 0, n - 1).astype(np.int32)
        counts = np.bincount(ids, minlength=n) + (1 if n == 40000 else 0)
        lengths = huffman.code_lengths(counts)
        assert lengths.max() <= 17 and (counts[lengths == 0] == 0).all()
        assert (0.5 ** lengths[lengths > 0].astype(float)).sum() <= 1
        code = huffman.Codec(lengths)
        parts = [ids[:7], ids[7:7], ids[7:1031], ids]
        coded = [(*code.encode(p), len(p)) for p in parts]
        for p, back in zip(parts, code.decode(coded), strict=True):
            assert (p == back).all()


def test_length_limit_is_optimal():
    """Against all monotone length vectors, by their Kraft sums."""
    import itertools

    for counts in ([1, 1, 2, 3, 5, 8], [1, 1, 1, 1, 100], [7], [3, 3], [1, 2, 4, 8, 16, 32]):
        best = min(sum(c * n for c, n in zip(counts, ls, strict=True)) for ls in itertools.product(range(1, 5), repeat=len(counts)) if sum(2.0**-n for n in ls) <= 1)
        got = huffman.code_lengths(np.array(counts), 4)
        assert sum(c * int(n) for c, n in zip(counts, got, strict=True)) == best


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 500)
    rows = [(7 * k % 1009, t) for k, t in enumerate([*TEXTS, None, *noise(200, 9)])]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, shard int").repartition(4)
    token_files.write_token_files(df, str(tmp_path / "t"), PATH)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, str(tmp_path / "t")).collect()}
    start = 0
    for k, t in sorted(rows):
        ids = [*library([t or ""])[0][0], 2]
        raw = np.array(ids, "<u4").tobytes()
        assert (got[k].start, got[k].n_tokens, zlib.crc32(bytes(got[k].ids))) == (start, len(ids), zlib.crc32(raw))
        start += len(ids)
    odd = spark.createDataFrame([(None, "b"), (5, "a"), (5, "a"), (None, None)], "doc_id long, text string")
    token_files.write_token_files(odd, str(tmp_path / "o"), PATH)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_files.read_token_files(spark, str(tmp_path / "o")).collect()) == [(0, 1), (0, 2), (5, 2), (5, 2)]
    token_files.write_token_files(df.limit(0), str(tmp_path / "e"), PATH)
    assert token_files.read_token_files(spark, str(tmp_path / "e")).collect() == []


def test_files_of_one_doc_id(spark, tmp_path):
    """Rows that share a doc_id fill several shards; starts still follow one another."""
    df = spark.createDataFrame([(k if k % 3 else 5, f"word {k} " * (k % 7)) for k in range(600)], "doc_id long, text string").repartition(4)
    token_files.write_token_files(df, str(tmp_path / "t"), PATH)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_token_files(spark, str(tmp_path / "t")).collect())
    assert [d for _, d, _ in got] == sorted(k if k % 3 else 5 for k in range(600))
    assert all(a + n == b for (a, _, n), (b, _, _) in zip(got, got[1:], strict=False))
    blocks = spark.read.parquet(str(tmp_path / "t/blocks")).select("shard", "doc_ids").collect()
    assert len({r.shard for r in blocks if (5).to_bytes(8, "little") in bytes(r.doc_ids)}) > 1
