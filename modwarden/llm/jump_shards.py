"""Sharding by jump consistent hashing.

A key walks a pseudo-random sequence of ever larger shard numbers and stays at the last one below the shard count.
With one more shard only keys whose next jump is that shard move, and they move into it.  There is no ring or
other table: key and shard count decide.  Here a batch of keys jumps together in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modwarden.llm import common
from modwarden.llm.shingles import mixed

#: Fixed values of the published algorithm: multiplier of its generator, and 2^31.
_STEP, _SCALE = np.uint64(2862933555777941757), float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each 64-bit key."""
    state = keys.astype(np.uint64).copy()
    at = np.zeros(len(state), dtype=np.int64)
    going = np.arange(len(state))
    while len(going):
        state[going] = state[going] * _STEP + np.uint64(1)
        draw = (state[going] >> np.uint64(33)).astype(np.float64) + 1.0
        nxt = ((at[going] + 1) * (_SCALE / draw)).astype(np.int64)
        stay = nxt < shards
        going = going[stay]
        at[going] = nxt[stay]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a long key, whose bits are mixed first; a null key counts as 0."""

    @F.pandas_udf(T.IntegerType())
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(mixed(keys.to_numpy().astype(np.int64).view(np.uint64)), shards), dtype="int32")

    return run(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assigned(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Per row: id, size (UTF-8 bytes of the text plus `overhead`), text_crc32, law, shard, slot and grown_shard.

    The law is `key`: id and shard count decide.  Slots count 0, 1, ... in a shard in order of id, then checksum,
    then size; rows equal in all three are interchangeable.  A null text has no bytes, a null id the key 0.  An empty
    table gives an empty result; other columns are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(F.col("__id"), shards)).withColumn("grown_shard", shard_of(F.col("__id"), shards + 1))
    placed = common.numbered(rows, ["shard"], "__id", ["text_crc32", "size"], "slot")
    return placed.select(F.col("__id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
