"""The pipeline against brute force: stages by themselves on planted rows, and as a whole on the sample table."""

import random

import corpus_pipeline
import public_tokenizers
from changeloom.llm import quality
from helpers import components
from test_decontaminate import brute
from tokenizers import Tokenizer

from pyspark.sql import functions as F


def test_whole_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    # the same steps in plain Python, but for the learned scores
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).where(F.col("__score") >= quality.THRESHOLD).select("doc_id").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    last = {}
    for d in sorted(rows):
        last[rows[d] or ""] = d
    rows = {d: rows[d] for d in last.values()}
    rows = {d: rows[d] for d, (_, c) in components(list(rows.items())).items() if c == d}
    hits = brute(list(rows.items()), items)
    rows = {d: t for d, t in rows.items() if len(hits[d][2]) <= 1 and hits[d][1] <= 0.5 * hits[d][0]}
    assert set(got) == set(rows)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    untouched = [d for d in rows if not hits[d][1]]
    assert untouched
    for d in untouched:
        assert got[d].ids == tok.encode(rows[d] or "", add_special_tokens=False).ids and got[d].n_tokens == len(got[d].ids)


#: The last columns carry names that the stages use inside.
INSIDE = ["__score", "__Hits", "__gone", "__size", "__prefix", "__text", "node", "component_id", "score", "keep_id", "group_size", "kept", "ids"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` double" for c in INSIDE)


def test_stages_keep_columns_and_take_odd_rows(spark, sf):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("etaoin") for _ in range(5))
    base = [word() for _ in range(60)]
    near = base[:30] + ["changed"] + base[31:]
    rows = [(1, " ".join(base), "en", "s", 1, 0.5), (2, " ".join(near), "en", "s", 1, 0.5), (3, None, None, None, None, None), (4, "", "en", "s", 0, 0.5), (5, " ".join(base), None, "s", 1, 0.5), (6, " ".join(word() for _ in range(30000)), "en", None, 1, None)]
    df = spark.createDataFrame([(*r[:5], *[r[5]] * len(INSIDE)) for r in rows], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.schema.names == df.schema.names, name
        assert all(r[c] == r["__score"] for r in out.collect() for c in INSIDE), name
        assert stage(spark, df.limit(0), sf).count() == 0
    by = dict(corpus_pipeline.STAGES)
    ids = lambda out: sorted(r.doc_id for r in out.select("doc_id").collect())
    assert ids(by["exact dedup"](spark, df, sf)) == [2, 4, 5, 6]
    assert ids(by["n-gram Jaccard join"](spark, df, sf)) == [1, 3, 4, 6]
    assert ids(by["benchmark decontamination"](spark, df, sf)) == [1, 2, 3, 4, 5, 6]
    last = by["BPE encoding and decoding"](spark, df, sf)
    assert last.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"] and last.count() == 6


def test_a_run_leaves_only_its_result(spark, sf):
    from changeloom.llm.storage import shared_folder

    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda: {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()
    before = names()
    assert corpus_pipeline.run(spark, sf).count() > 0
    (left,) = names() - before
    stages = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{left}"))]
    assert stages == [f"stage-{len(corpus_pipeline.STAGES) - 1}"]
