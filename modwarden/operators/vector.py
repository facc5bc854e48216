"""Nearest-neighbour search by cosine, and tables of vectors.

An index of at most BROADCAST_BYTES goes to every executor once and probes do not move.  A larger one is read in blocks;
each block travels to all probes once and leaves one best row a probe, so no table of all pairs exists and memory does
not grow with either side.  Both ways compare every probe with every indexed vector exactly.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modwarden.functions import hashing
from modwarden.functions import text as X

#: Indexed vectors in one block, and bytes of an index that is sent whole.
BLOCK_ROWS, BROADCAST_BYTES = 8_192, 32_000_000
#: Categories of the indexed words that block a message by one word's vector.
PROFANITY = ("seed_profanity", "live_trained_profanity")


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in rows])
    n = np.sqrt((m * m).sum(axis=1))
    return m / np.where(n > 0, n, 1.0)[:, None]


_FOUND = "id long, match long, score double"


def _best(probe: pd.DataFrame, known: np.ndarray, ids: np.ndarray, skip_self: bool) -> pd.DataFrame:
    """The best of `known`, whose ids ascend, for each probe."""
    out = [pd.DataFrame({"id": [], "match": [], "score": []}).astype({"id": "int64", "match": "int64", "score": "float64"})]
    for i in range(0, len(probe) if len(known) else 0, 1024):
        part = probe.iloc[i : i + 1024]
        cos = _unit(part["vector"]) @ known.T
        if skip_self:
            cos[part["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        at = cos.argmax(axis=1)
        out.append(pd.DataFrame({"id": part["id"].to_numpy(), "match": ids[at], "score": cos[np.arange(len(part)), at]}))
    return pd.concat(out[1:]) if len(out) > 1 else out[0]


def top1(probes: DataFrame, index: DataFrame, threshold: float, skip_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, match, score: the indexed vector of greatest cosine (ties: smallest id) of each probe, if it reaches threshold.

    probes and index have id (long) and vector.  Null vectors match nothing.  A small index is broadcast, after its size
    has been counted; else every probe meets every block of it in a group of (probe block, index block).
    """
    p, x = probes.where("vector is not null").select("id", "vector"), index.where("vector is not null").select("id", "vector")
    size = x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vector")).alias("cells")).first()
    n = size["n"]
    if not n:
        return probes.select("id", F.col("id").alias("match"), F.lit(0.0).alias("score")).limit(0)
    if 8 * size["cells"] <= BROADCAST_BYTES:
        rows = x.orderBy("id").toPandas()
        sent = p.sparkSession.sparkContext.broadcast((_unit(rows["vector"]), rows["id"].to_numpy()))

        def search(frames):
            known, ids = sent.value
            for frame in frames:
                yield _best(frame, known, ids, skip_self)

        return p.mapInPandas(search, _FOUND).where(F.col("score") >= threshold)
    m = p.count()
    if not m:
        return probes.select("id", F.col("id").alias("match"), F.lit(0.0).alias("score")).limit(0)
    nx, np_ = -(-n // block_rows), -(-m // block_rows)
    # each side goes once to every block of the other
    left = p.select("id", "vector", F.lit(0).alias("side"), F.pmod(F.xxhash64("id"), F.lit(np_)).alias("a")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nx - 1).cast("long"))))
    right = x.select("id", "vector", F.lit(1).alias("side"), F.pmod(F.xxhash64("id"), F.lit(nx)).alias("b")).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(np_ - 1).cast("long")))).select("id", "vector", "side", "a", "b")

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        probe, known = frame[frame["side"] == 0], frame[frame["side"] == 1].sort_values("id")
        return _best(probe, _unit(known["vector"]) if len(known) else np.zeros((0, 0)), known["id"].to_numpy(), skip_self)

    found = left.unionByName(right).groupBy("a", "b").applyInPandas(best, _FOUND)
    top = found.where("score > double('-infinity')").groupBy("id").agg(F.max(F.struct("score", (-F.col("match")).alias("m"))).alias("t"))
    return top.select("id", (-F.col("t.m")).alias("match"), F.col("t.score").alias("score")).where(F.col("score") >= threshold)


def upserted(table: DataFrame, batch: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """table with the rows of batch put in by key: the row of greatest version stays (ties: the batch's)."""
    both = table.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.col(version).desc(), F.col("__new").desc())
    return both.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn", "__new")


def bootstrapped(words: DataFrame, word_col: str = "word") -> DataFrame:
    """id, text and category of seed words: normalised, distinct, with their FNV ids."""
    w = words.select(X.seed_word(F.col(word_col)).alias("text")).where("text is not null").distinct()
    return w.select(hashing.fnv1a64(F.col("text")).alias("id"), "text", F.lit("seed_profanity").alias("category"))


@lru_cache(maxsize=200_000)
def _place(gram: str) -> tuple[int, int]:
    h = int(hashlib.md5(gram.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return h, 1 if (h >> 16) & 1 else -1


def hashed_ngrams(dim: int = 64, n: int = 3):
    """A deterministic stand-in for a text embedding: signed counts of hashed character n-grams, as an Arrow UDF.  The first
    32 bits of a gram's MD5 give its place and sign.  A null text has a null vector."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            v = np.zeros(dim)
            padded = f" {t.lower()} "
            for i in range(len(padded) - n + 1):
                h, sign = _place(padded[i : i + n])
                v[h % dim] += sign
            return v

        return texts.map(one)

    return embed


#: A vector table as it is first made: one placeholder, so that a search always has a row.
PLACEHOLDER = {"id": 1, "text": "placeholder", "category": "bootstrap"}


def placeholder(spark: SparkSession, dim: int = 384) -> DataFrame:
    """The row that a new vector table has: id 1 and 0.5 in every dimension."""
    return spark.range(1).select(F.lit(PLACEHOLDER["id"]).cast("decimal(20,0)").alias("id"), F.lit(PLACEHOLDER["text"]).alias("text"), F.lit(PLACEHOLDER["category"]).alias("category"), F.array_repeat(F.lit(0.5), dim).alias("vector"))


def trained(texts: DataFrame, embed, text_col: str = "text") -> DataFrame:
    """Rows of a vector table for texts that are learned while messages come in: their ids are those of the texts."""
    t = texts.select(F.col(text_col).alias("text")).where("text is not null").distinct()
    return t.select(hashing.fnv1a64(F.col("text")).alias("id"), "text", F.lit("live_trained_profanity").alias("category"), embed(F.col("text")).alias("vector"))
