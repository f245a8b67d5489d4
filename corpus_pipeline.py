"""A corpus-cleaning pipeline of five operators of changeloom.llm, each stage written and read again.

All stages but the last return the columns of documents; the last returns each document's token ids
and the text they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm import bpe
from changeloom.llm.decontaminate import decontaminate
from changeloom.llm.exact_dedup import exact_duplicate_filter
from changeloom.llm.ngram_join import near_duplicate_filter
from changeloom.llm.quality import quality_filter
from changeloom.llm.storage import Workspace, temporary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the one with the largest doc_id stays."""
    return exact_duplicate_filter(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked near copies the one with the smallest doc_id stays."""
    return near_duplicate_filter(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with two or more benchmark items, or mostly of benchmark words, go; a lone passage is cut out of the text."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded) of each document."""
    import public_tokenizers

    coded = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: A learned model and connected components have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with temporary():  # what a stage's operators wrote goes when its result is written
            docs = work.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            work.drop(f"stage-{k - 1}")
    return docs
