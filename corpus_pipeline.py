"""Corpus preparation: quality rules, MinHash near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modwarden import staging
from modwarden.llm import common, length_buckets, odd_minhash, quality_cascade, suffix_dedup, token_counts
from modwarden.llm.queries import tokenizer_path
from modwarden.session import prepare

#: Words of a repeated passage that the corpus may not keep: over 50.
PASSAGE_WORDS = 51


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule cascade keeps."""
    prepare(spark)
    return quality_cascade.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five words, similarity 0.8)."""
    prepare(spark)
    return odd_minhash.first_of_groups(docs, width=5, percent=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of over 50 words that also stand elsewhere; n_chars follows the text."""
    prepare(spark)
    return suffix_dedup.without_passages(docs, words=PASSAGE_WORDS).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and place of each document by its BPE tokens."""
    prepare(spark)
    staging.small_batches(spark)
    return length_buckets.packed(docs, token_counts.n_tokens(F.col("text"), tokenizer_path("byte_bpe_50k.json")))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("packing", packing)]

#: Similarity joins, suffix arrays and the choice of bounds have no plain SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again.

    Null and empty texts go in the first stage; of rows that repeat another one stays; null ids and columns named like a
    stage's own are kept as they are.  An empty table gives an empty result."""
    prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staging.staged(docs)
    return docs
