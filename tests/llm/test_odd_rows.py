"""Every operator on one table of odd rows: nulls in any column, repeats, very long and empty texts, clashing column names; and on empty tables."""

import hashlib

import public_tokenizers
import pytest
from changeloom.llm import bpe, decontaminate, exact_dedup, htmltext, langid, licenses, ngram_join, quality, queries, token_files, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [
    (1, "the cat sat on the mat and ran", "en", "s", None, 1, 2, "x", 0.1),
    (1, "the cat sat on the mat and ran", "en", "s", None, 1, 2, "x", 0.1),
    (None, "no id here but words", None, None, None, None, None, None, None),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "de", "s", 0, 0, 0, "", 0.0),
    (4, "\x00\n\t  ", "de", "s", 0, 0, 0, "", 0.0),
    (5, "wort " * 60000, "de", "s", 0, 0, 0, "", 0.0),
    (6, "x" * 300000, "de", "s", 0, 0, 0, "", 0.0),
    (7, "the cat sat on the mat and ran", "en", "t", None, 1, 2, "x", 0.1),
]
# the last columns carry names that operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, node long, ids string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def operators(spark, tmp):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, None, None), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "the cat sat on the mat and ran away"), (2, None), (None, "words"), (4, "")], "item_id long, text string")

    def files(df):
        token_files.write_token_files(df, f"{tmp}/{id(df)}", PATH)
        return token_files.read_token_files(spark, f"{tmp}/{id(df)}")

    return {
        "ngram": ngram_join.ngram_components, "toxicity": lambda d: toxicity.classify(d, labels), "licenses": licenses.scan_licenses,
        "html": lambda d: htmltext.extract(d.withColumnRenamed("text", "html").withColumnRenamed("source", "url"), "doc_id"), "quality": lambda d: quality.classify(d, labels),
        "found": lambda d: decontaminate.find_contamination(d, items), "exact": exact_dedup.exact_duplicates, "files": files, "bpe": lambda d: bpe.encode_decode(d, PATH), "langid": langid.predict_languages,
    }


def test_a_row_for_each_row(spark, docs, tmp_path):
    for name, run in operators(spark, tmp_path).items():
        got = run(docs).collect()
        assert len(got) == len(ROWS), name
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS), name


def test_empty_tables(spark, docs, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    for name, run in operators(spark, tmp_path).items():
        out = run(none)
        assert out.collect() == [] and "doc_id" in out.columns, name


def test_exact_dedup_query(spark, docs, tmp_path):
    other = spark.createDataFrame([(1, "another text of a repeated id"), (None, None)], "doc_id long, text string")
    docs.unionByName(other, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_exact_dedup(spark, str(tmp_path)).collect()
    texts = [(r[0], r[1] or "") for r in [*ROWS, (1, "another text of a repeated id"), (None, None)]]
    size = lambda t: sum(u == t for _, u in texts)
    assert sorted(((r.doc_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(((k, size(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in texts), key=str)


def write_tables(spark, folder, rows):
    """The tables that the registered queries read, from odd rows."""
    docs = spark.createDataFrame([*rows], SCHEMA).repartition(2)
    docs.write.parquet(f"{folder}/documents.parquet")
    known = [(1, 1, 0, "x"), (3, 0, 1, "x"), (5, None, None, None), (None, 1, 1, None), (7, 1, 0, "x"), (7, 1, 0, "x")]
    spark.createDataFrame(known if rows else [], "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    items = [(1, "the cat sat on the mat and ran away", 1), (2, None, 2), (None, "words", 3), (4, "", 4), (1, "words again", 5)]
    spark.createDataFrame(items if rows else [], "item_id long, text string, doc_id long").write.parquet(f"{folder}/benchmark.parquet")
    pages = docs.selectExpr("doc_id as page_id", "source as url", "text as html", "text", "score as n_chars")
    pages.write.parquet(f"{folder}/pages.parquet")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_on_odd_rows(spark, tmp_path_factory, name):
    folders = [str(tmp_path_factory.mktemp("odd")) for _ in range(2)]
    write_tables(spark, folders[0], ROWS)
    write_tables(spark, folders[1], [])
    got = queries.queries()[name](spark, folders[0]).collect()
    key = "page_id" if "page_id" in got[0].asDict() else "doc_id"
    assert sorted(str(r[key]) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert queries.queries()[name](spark, folders[1]).collect() == []
