"""The queries of this subpackage: each applies one operator to its whole table; SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, htmltext, langid, licenses, ngram_join, quality, token_files, toxicity
from .storage import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct("matches.license"))
    return found.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("containment"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.size("item_ids").cast("long")
    return found.select("doc_id", "n_words", "n_hit", items.alias("n_items"), F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (items >= 2).alias("contaminated"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), digests=True)


def op8_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "op8")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), f"{work.root}/tokens", _tokenizer(), end_id=2, work=work)
    read = token_files.read_token_files(spark, f"{work.root}/tokens")
    return read.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_table(spark, sf_dir, "documents"), _tokenizer())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _template_rows() -> str:
    return ", ".join("({}, '{}', '{}')".format(k, *(x.replace("'", "''") for x in t)) for k, t in enumerate(licenses.TEMPLATES))


SQL = {
    "op1_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, sym.b FROM reach r JOIN sym ON sym.a = r.other),
        least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least LEFT JOIN n USING (doc_id)""",
    "op3_license_scan": f"""
        WITH t AS (SELECT k, license, regexp_extract_all(lower(words), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM (VALUES {_template_rows()}) v(k, license, words)),
        tn AS (SELECT k, license, w, CAST(greatest(4, pow(2, ceil(log2(len(w))))) AS BIGINT) AS size FROM t),
        tg AS (SELECT DISTINCT k, size, license, w[i] || ' ' || w[i + 1] AS g FROM (SELECT *, unnest(range(1, len(w))) AS i FROM tn)),
        tc AS (SELECT k, count(*) AS n FROM tg GROUP BY k),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        dg AS (SELECT doc_id, i - 1 AS p, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
        hit AS (SELECT doc_id, k, license, p // size AS b, g FROM dg JOIN tg USING (g)),
        win AS (SELECT doc_id, k, license, b, g FROM hit UNION ALL SELECT doc_id, k, license, b - 1, g FROM hit WHERE b > 0),
        share AS (SELECT doc_id, license, count(DISTINCT g) / n AS share FROM win JOIN tc USING (k) GROUP BY doc_id, k, license, b, n),
        good AS (SELECT doc_id, list_sort(list_distinct(list(license))) AS l, max(share) AS m FROM share WHERE share >= {licenses.LEAST} GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_licenses, coalesce(array_to_string(l, ','), '') AS licenses, coalesce(m, 0.0) AS containment
        FROM d LEFT JOIN good USING (doc_id)""",
    # for pages of plain articles, as the sample tables have them
    "op4_html_extraction": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS x FROM pages),
        b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(?:p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM a),
        c AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS x FROM b),
        t AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM c)
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t""",
    "op6_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        k AS (SELECT item_id, w, least(len(w), 8) AS n FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, n, w[i : i + n - 1] AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM k)),
        sizes AS (SELECT DISTINCT n FROM win),
        grams AS (SELECT doc_id, n, i, w[i : i + n - 1] AS g
                  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        occ AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.n = win.n AND g.g = win.g),
        hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
