"""Which texts hold which passages: a containment join by the passages' rarest word pairs.

A passage is looked for in the texts that share one word pair with it, that of its inner pairs which the fewest texts
hold, so a pair that a third of all texts hold decides nothing.  Passages of fewer than four words have no inner pair;
they are looked for in every text, as one broadcast table up to SHORT_PASSAGES of them, and block by block beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modwarden import staging

#: Passages without an inner word pair that are looked for at a time.
SHORT_PASSAGES = 1_000


def _words(c: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")


def _pairs(words: Column) -> Column:
    """Distinct pairs of neighbouring words, as hashes.

    The words are named outside the lambda only: inside, they would be split again for every pair."""
    lead = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_distinct(F.zip_with(lead, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)))


def passages_in(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, id) of the passages (item_id, passage) that stand in a text, character by character.

    Null texts hold nothing, null and empty passages stand nowhere."""
    items = staging.staged(passages.where("passage <> ''").select("item_id", "passage", _words(F.col("passage")).alias("w")))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.col("__text").isNotNull())
    # a passage may begin and end inside a word, so only its inner words are whole words of the text
    inner = F.slice("w", 2, F.size("w") - 2)
    keyed = items.where(F.size("w") >= 4).select("item_id", "passage", F.explode(_pairs(inner)).alias("key"))
    keys = staging.staged(keyed.select("key").distinct())
    held = texts.select("__id", F.xxhash64("__text").alias("__h"), F.explode(_pairs(_words(F.col("__text")))).alias("key")).join(keys, "key", "left_semi")
    held = staging.staged(held)
    often = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    best = keyed.join(often, "key").groupBy("item_id", "passage").agg(F.min(F.struct("n", "key"))["key"].alias("key"))
    near = held.join(best, "key").select("item_id", "passage", F.col("__id").alias("__near"), "__h").distinct()
    hashed = texts.withColumn("__hash", F.xxhash64("__text"))
    found = near.join(hashed, (F.col("__h") == F.col("__hash")) & F.col("__near").eqNullSafe(F.col("__id"))).where(F.col("__text").contains(F.col("passage"))).select("item_id", "__id")
    short = items.where(F.size("w") < 4).select("item_id", "passage")
    n = short.count()
    blocks = -(-n // SHORT_PASSAGES)
    for b in range(blocks):
        some = short.where(F.pmod(F.xxhash64("passage"), F.lit(blocks)) == b)
        found = found.unionByName(texts.join(F.broadcast(some), F.col("__text").contains(F.col("passage"))).select("item_id", "__id"))
    return found.distinct().select("item_id", F.col("__id").alias(id_col))
