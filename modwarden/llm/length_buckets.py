"""Packing into length buckets whose bounds minimise padding over the global histogram.

Lengths fall into the cells of a fixed grid: multiples of 64 to 65,536, then 64 steps an octave.  The histogram, a count
and the greatest length of each cell, has at most about 3,700 rows whatever the input, so it goes to the driver, where
dynamic programming finds the bounds, among those greatest lengths, of least padding for the given number of buckets.
As rows of one cell share a bound, only they are padded without need, by less than a cell's width.  Each bucket's rows form batches of
as many rows as fit the token budget at the bucket's bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modwarden import staging
from modwarden.llm import common

GRID_STEP, FINE_TO, OCTAVE_STEPS = 64, 65_536, 64


def on_grid(length: Column) -> Column:
    """The least grid point that holds a length (a length of 0 takes the first)."""
    x = F.greatest(length.cast("long"), F.lit(1).cast("long"))
    fine = F.ceil(x / GRID_STEP).cast("long") * GRID_STEP
    # beyond the fine part a step is 2^(bits of x-1, less 7)
    step = F.pow(F.lit(2.0), F.length(F.bin(x - 1)) - (OCTAVE_STEPS.bit_length())).cast("long")
    return F.when(x <= FINE_TO, fine).otherwise(F.ceil(x / step).cast("long") * step)


def best_bounds(points: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bounds, the last grid point included, that minimise the sum of count * bound with at most `buckets` buckets."""
    g = len(points)
    if not g:
        return []
    total = np.concatenate(([0], np.cumsum(counts)))
    best = points * total[1:]  # one bucket for the first i + 1 points
    came = [np.zeros(g, dtype=np.int64)]
    for _ in range(1, min(buckets, g)):
        nxt, frm = best.copy(), np.full(g, -1, dtype=np.int64)
        for i in range(1, g):
            cost = best[:i] + points[i] * (total[i + 1] - total[1 : i + 1])
            k = int(np.argmin(cost))
            if cost[k] < nxt[i]:
                nxt[i], frm[i] = cost[k], k
        best = nxt
        came.append(frm)
    bounds, i = [int(points[g - 1])], g - 1
    for frm in reversed(came[1:]):
        if frm[i] >= 0:
            i = int(frm[i])
            bounds.append(int(points[i]))
    return sorted(bounds)


def packed(docs: DataFrame, length: Column, id_col: str = "doc_id", buckets: int = 12, token_budget: int = 262_144) -> DataFrame:
    """Per row: id, length, bucket, bound, batch (within the bucket), place (within the batch), batch_rows, padding.

    A batch holds floor(token_budget / bound) rows; a row longer than the budget has a batch of its own and is not
    cut.  Batches fill in the order of a hash of the id, which mixes sources.  Only the last batch of a bucket may
    be part full.  Null texts have length 0.  An empty table gives an empty result.  Other columns are left out; rows
    of a null or repeated id each have a place.  Lengths are computed once and written.
    """
    rows = staging.staged(docs.select(F.col(id_col).alias("__id"), F.coalesce(length, F.lit(0)).cast("long").alias("length")))
    most = F.greatest(F.max("length"), F.lit(1).cast("long"))
    seen = sorted((r["most"], r["n"]) for r in rows.groupBy(on_grid(F.col("length")).alias("point")).agg(most.alias("most"), F.count(F.lit(1)).alias("n")).collect())
    bounds = best_bounds(np.array([p for p, _ in seen], dtype=np.int64), np.array([n for _, n in seen], dtype=np.int64), buckets)
    bucket, bound = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, b in reversed(list(enumerate(bounds))):
        inside = F.col("length") <= b
        bucket, bound = F.when(inside, F.lit(i)).otherwise(bucket), F.when(inside, F.lit(b).cast("long")).otherwise(bound)
    placed = rows.withColumn("bucket", bucket).withColumn("bound", bound).withColumn("__mix", F.xxhash64("__id"))
    lengths, rows = rows, common.numbered(placed, ["bucket"], "__mix", ["__id", "length"], "__slot")
    staging.discard(lengths)
    per = F.greatest(F.floor(F.lit(token_budget) / F.col("bound")), F.lit(1)).cast("long")
    return rows.withColumn("batch_rows", per).select(
        F.col("__id").alias(id_col),
        "length",
        "bucket",
        "bound",
        F.floor(F.col("__slot") / F.col("batch_rows")).cast("long").alias("batch"),
        F.pmod(F.col("__slot"), F.col("batch_rows")).alias("place"),
        "batch_rows",
        (F.col("bound") - F.col("length")).alias("padding"),
    )
