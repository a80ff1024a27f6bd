"""The corpus pipeline: quality rules, n-gram Jaccard join, suffix-array dedup, PII and packing.

Each stage takes the documents that its predecessor kept. The stages are linked by
Parquet tables in the shared folder, so a lost executor repeats one stage's tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm import jaccard, packing, pii, quality, suffix
from loamwork.llm.common import documents, labels, materialize
from loamwork.llm.queries import pii_key, tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    return quality.keep(docs, labels(spark, sf_dir))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return jaccard.representatives(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated passages go; n_chars follows the text."""
    return _recounted(suffix.without_repeats(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated personal data become pseudonyms of the same format."""
    return _recounted(pii.pseudonymize(docs, pii_key(spark), counts=False))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences of 2048."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", jaccard_stage),
    ("suffix_array_dedup", suffix_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can express neither the learned rules nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table on."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
