"""The corpus pipeline: quality rules, exact and near deduplication, masking of personal data, packing.

Every stage reads all that the one before it kept, and its decisions take effect: rejected
documents and copies are gone, one document of each group of near copies stays (the smallest
doc_id), personal data is replaced by its kind, and the last stage packs what is left.  Each result
is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import exact_dedup, jaccard_join, packing, pii, quality_rules
from quillspan.llm.common import stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs, pii.fit(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", good_documents),
    ("exact_dedup", distinct_documents),
    ("ngram_jaccard_join", one_of_near_copies),
    ("pii", masked_documents),
    ("best_fit_packing", sequences),
]

#: SQL expresses neither the decoded spans of the network nor best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
