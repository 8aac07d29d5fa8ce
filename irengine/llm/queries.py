"""Queries of the ten operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irengine.llm import op1_sentencepiece, op2_decontamination, op3_token_counts, op4_quality_rules, op5_quality_classifier, op6_toxicity, op7_language_id, op8_minhash, op9_token_output, op10_license
from irengine.llm.common import read

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_sentencepiece.round_trip(read(spark, sf_dir, "documents"), PIECES)


def op2_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_token_counts.token_counts(read(spark, sf_dir, "documents"), PIECES)


def op4_quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_quality_rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_quality_classifier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_quality_classifier.quality_classifier(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_language_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_language_id.language_id(read(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_token_output_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_token_output.token_output(read(spark, sf_dir, "documents"), BYTES)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_license.license_scan(read(spark, sf_dir, "documents"))


def sentencepiece_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1, relational throughout: digests of the joined ids."""
    ids = op1_sentencepiece.encode_joined(read(spark, sf_dir, "documents"), PIECES)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece_round_trip, "op2_decontamination": op2_benchmark_overlap, "op3_token_counts": op3_token_counts_query, "op4_quality_rules": op4_quality_rules_query, "op5_quality_classifier": op5_quality_classifier_query,
    "op6_toxicity": op6_toxicity_query, "op7_language_id": op7_language_id_query, "op8_minhash": op8_near_duplicates, "op9_token_output": op9_token_output_query, "op10_license_scan": op10_license_scan,
    "sentencepiece_joined": sentencepiece_joined,
}
ORACLE_SQL = {"op2_decontamination": op2_decontamination.ORACLE_SQL, "op10_license_scan": op10_license.oracle_sql()}
