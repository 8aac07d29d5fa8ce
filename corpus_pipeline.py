"""A corpus pipeline of five stages, each of which calls one operator of irengine.llm.

Every stage reads what the stage before it has kept, from Parquet. Stages drop
documents, never change them; the last one returns encodings in place of texts:
(doc_id, ids, n_pieces, ids_crc32, n_bytes, round_trip).
Labels are learnt from the whole corpus at sf_dir.

Near copies are texts whose sets of five-word shingles have a similarity of 0.8 or
more (NEAR_PERCENT); of each group of them the one with the smallest doc_id stays.

Every row is judged by its own text, whatever its doc_id: rows that share a doc_id, or have none, stand for
themselves, and of repeated rows one stays. Null texts and texts without words go in the first stage. Very long texts
are judged, compared and encoded whole. Equal scores and ties fall as the operators say. Other columns, whatever
their names, pass through up to the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from irengine.llm import op1_sentencepiece, op2_decontamination, op4_quality_rules, op5_quality_classifier, op8_minhash
from irengine.llm.common import discard, read, scratch_path
from irengine.llm.queries import PIECES

#: The stages' verdicts come from trained models and a byte-pair vocabulary, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None

NEAR_PERCENT = 80  # op8_minhash derives its bands from it


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_quality_rules.keep(docs, op4_quality_rules.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # learnt from the whole corpus: among what the rules have kept, bad documents are too few to learn from
    return op5_quality_classifier.keep(docs, op5_quality_classifier.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_minhash.keep(docs, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_sentencepiece.encode_checked(docs, PIECES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs


