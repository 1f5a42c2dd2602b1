"""The corpus pipeline: low-quality documents go, then exact and near copies, then personal data; the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from syllagraph.llm.common import documents, saved
from syllagraph.llm.exact_dedup import distinct_documents
from syllagraph.llm.near_join import one_per_class
from syllagraph.llm.packing import pack_documents
from syllagraph.llm.pii import redact_personal_data
from syllagraph.llm.quality_gbt import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of equal texts the document with the largest doc_id stays."""
    return distinct_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each class of near copies stays."""
    return one_per_class(docs, n=5, threshold=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: personal data is replaced by its kind in brackets."""
    return redact_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the pieces of sequences of 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Trained models and message passing have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
