"""Corpus pipeline: quality rules, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of documents; run() writes each result as a table in the shared folder and reads it again as the next one's input.

Decisions: documents that fail the base rules or the compression bands go; of each group of near copies the document with the
smallest doc_id stays; personal data is replaced by its kind in brackets; what is left is packed. Rows with a null
text fail the quality rules; rows with a null doc_id are kept as documents of their own; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import ngram_join, packing, pii, quality
from tessel.llm.common import written
from tessel.llm.vocab import public_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.sequences(docs, public_path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_copies), ("personal data", personal_data), ("packing", packed)]

#: Compression, tokens and the span model have no SQL form; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
