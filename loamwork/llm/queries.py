"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamwork.llm import bpe, huffman, jaccard, lm, media, merkle, packing, pieces, pii, quality, resample, sql, suffix, toxicity
from loamwork.llm.common import benchmark, documents, labels


def tokenizer(name: str) -> str:
    """The path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pii_key(spark: SparkSession) -> bytes:
    """The key of pseudonyms: the session's setting loamwork.pii.key. Where it is unset, as in tests, a public one and a warning."""
    key = spark.conf.get("loamwork.pii.key", None)
    if key is None:
        warnings.warn("loamwork.pii.key is unset: pseudonyms made with the public test key can be undone by anyone", stacklevel=2)
    return (key or "public-test-key").encode()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of every document."""
    return bpe.encode_decode(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing of every document into sequences of 2048 ids."""
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Huffman-coded id files of every document, read back."""
    return huffman.write_and_read(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 400-byte repeats cover."""
    return suffix.removal(documents(spark, sf_dir))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as media in tar shards and read back."""
    return media.media_columns(documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle-set size and component of every document."""
    return jaccard.join(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and verdict of every document."""
    return quality.judge(documents(spark, sf_dir), labels(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; documents labelled as good are the target."""
    good = labels(spark, sf_dir).where("quality = 1").select("doc_id")
    return lm.score(documents(spark, sf_dir), good)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and counts of what they replace."""
    return pii.pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), pii_key(spark))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and ranks of every document, drawn towards the benchmark's texts."""
    return resample.resample(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and checked proof of every document."""
    return merkle.manifest(documents(spark, sf_dir))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding of every document."""
    return pieces.encode_decode(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {f.__name__: f for f in (op1_bpe, op2_best_fit_packing, op3_token_files, op4_toxicity, op5_suffix_array_dedup, op6_media_columns, op7_jaccard_join, op8_quality_rules, op9_lm_scoring, op10_pii, op11_importance_resampling, op12_merkle_manifest, op13_sentencepiece)}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, where SQL can express the query."""
    return {"op11_importance_resampling": sql.RESAMPLE, "op12_merkle_manifest": sql.MANIFEST}
