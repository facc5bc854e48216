"""The queries opN_<name> over the driver's tables; each is a thin view of its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modwarden import staging
from modwarden.llm import (
    chat_rotation,
    common,
    jump_shards,
    lattice_dedup,
    length_buckets,
    license_scan,
    odd_minhash,
    quality_cascade,
    sentencepiece_lattice,
    suffix_dedup,
    token_counts,
)
from modwarden.llm.sql import ORACLES  # noqa: F401  (read by the driver's entry)


#: Words of a repeated passage that op10's text may not keep: over 50.
PASSAGE_WORDS = 51


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file lies; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents on all cores, for operators whose work on a text is many times that of reading it."""
    return staging.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging.small_batches(spark)
    return token_counts.count_tokens(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotated(common.table(spark, sf_dir, "conversations"))


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards.assigned(common.table(spark, sf_dir, "documents"), shards=24)


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.report(_documents(spark, sf_dir))


def op5_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(common.table(spark, sf_dir, "embeddings"), least=0.95)


def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are UTF-8 bytes, the tokens of a model without a vocabulary; the pipeline packs by BPE tokens."""
    return length_buckets.packed(common.table(spark, sf_dir, "documents"), F.octet_length("text"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(common.table(spark, sf_dir, "documents")).drop("detections")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encoded(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op9_odd_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_minhash.near_duplicates(_documents(spark, sf_dir), width=4, percent=80)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_report(_documents(spark, sf_dir), length=400, words=PASSAGE_WORDS)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_chat_rotation": op2_chat_rotation,
    "op3_jump_shards": op3_jump_shards,
    "op4_quality_cascade": op4_quality_cascade,
    "op5_lattice_dedup": op5_lattice_dedup,
    "op6_length_buckets": op6_length_buckets,
    "op7_license_scan": op7_license_scan,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_odd_minhash": op9_odd_minhash,
    "op10_suffix_dedup": op10_suffix_dedup,
}
