"""The registered queries of the subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup as dedup
from . import filter_audit, near_join
from .common import documents
from .language_ppm import identify_languages
from .license_scan import scan_licenses
from .packing import pack_documents
from .piece_fst import encode_pieces
from .pii import find_personal_data
from .quality_gbt import classify_quality
from .quality_rules import apply_quality_rules
from .secrets import scan_secrets
from .token_alignment import align_tokenizers
from .token_count import count_tokens


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return scan_secrets(documents(spark, sf_dir))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return near_join.jaccard_join(documents(spark, sf_dir), n=5, threshold=0.8)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and learned verdict of every document."""
    return apply_quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    return dedup.exact_dedup(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return classify_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece identifiers of every document and their text."""
    return encode_pieces(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License citations and wording in every document."""
    return scan_licenses(documents(spark, sf_dir))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return find_personal_data(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens."""
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return identify_languages(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, by source."""
    return filter_audit.audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document, and how common its links are."""
    return align_tokenizers(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_piece_encoding": op7_piece_encoding,
    "op8_license_scan": op8_license_scan,
    "op9_personal_data": op9_personal_data,
    "op10_packing": op10_packing,
    "op11_language_id": op11_language_id,
    "op12_filter_audit": op12_filter_audit,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

SQL: dict[str, str] = {
    "op2_jaccard_join": near_join.SQL,
    "op4_exact_dedup": dedup.SQL,
    "op12_filter_audit": filter_audit.SQL,
}
