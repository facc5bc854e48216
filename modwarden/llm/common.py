"""What the corpus operators share: gapless numbering, groups of sorted partitions, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from modwarden import staging

#: Blocks that even a small table is cut into for numbering, if it has 2,000 rows for each.
SMALL_BLOCKS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives what a Python worker has freed back to the system.  Workers outlive their tasks, and an executor keeps more of them
    than it has cores, each at its peak otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def content_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text, F.octet_length(text)).alias("h2"))


def running(df: DataFrame, groups: list[str], key: str, ties: list[str], value: Column, out: str, block_rows: int = 1_000_000) -> DataFrame:
    """Adds `out`, the sum of `value` over the rows before each row in the order of (key, ties) within its group.

    Nulls come first.  Rows equal in key and ties are interchangeable, and stand in the order of a number of their own,
    so neither a hot group nor a hot key, not even one of equal rows only, is sorted in one task: all rows are cut
    by ranges of (groups, key, ties, number) into blocks, sums run inside (group, block) and are shifted by the
    sums of the group's earlier blocks.  df is computed once and written; its blocks are written too, as both
    sums read them.  Keep its rows short (ties are sampled to the driver by the range cut: a digest in place of a text).
    """
    spark = df.sparkSession
    rows = staging.staged(df.withColumns({"__value": value.cast("long"), "__number": F.monotonically_increasing_id()}))
    total = rows.count()
    blocks = max(1, -(-total // block_rows), min(SMALL_BLOCKS, -(-total // 2_000)))
    order = [F.col(c).asc_nulls_first() for c in (key, *ties, "__number")]
    cut = staging.staged(rows.repartitionByRange(blocks, *[F.col(g).asc_nulls_first() for g in groups], *order).withColumn("__block", F.spark_partition_id()))
    staging.discard(rows)
    earlier = Window.partitionBy(*groups).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        cut.groupBy(*groups, "__block")
        .agg(F.sum("__value").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0).cast("long")))
        .select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__block").alias("__gb"), "__before")
    )
    inside = Window.partitionBy(*groups, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.withColumn("__own", F.coalesce(F.sum("__value").over(inside), F.lit(0).cast("long")))
    same = F.col("__block") == F.col("__gb")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return ranked.join(before, same, "left").select(*[c for c in df.columns if c != out], (F.col("__own") + F.col("__before")).alias(out))


def numbered(df: DataFrame, groups: list[str], key: str, ties: list[str], out: str, block_rows: int = 1_000_000) -> DataFrame:
    """Adds `out`, 0, 1, ... without gaps in the order of (key, ties) within each group; see running()."""
    return running(df, groups, key, ties, F.lit(1), out, block_rows)


def tasks_for(spark: SparkSession, rows: int, rows_a_task: int) -> int:
    """A number of partitions, all cores at least, for so many rows.  Given to repartition() it also keeps adaptive
    execution from joining partitions whose rows are few bytes and much work."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_a_task))


def whole_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The groups of a partition sorted by key, one at a time."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        k = frame[key].to_numpy()
        cuts = (k[1:] != k[:-1]).nonzero()[0] + 1
        edges = [0, *cuts.tolist(), len(frame)]
        for i, j in zip(edges, edges[1:]):
            part = frame.iloc[i:j]
            if held and held[0][key].iloc[0] != part[key].iloc[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def group_blocks(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames of a partition sorted by key that each hold whole groups, as many as a batch has."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        k = frame[key].to_numpy()
        cuts = (k[1:] != k[:-1]).nonzero()[0] + 1
        if held and held[-1][key].iloc[-1] != k[0]:
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        if len(cuts):
            held.append(frame.iloc[: cuts[-1]])
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        held.append(frame.iloc[cuts[-1] if len(cuts) else 0 :])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, component_id = smallest node).

    Rounds of contraction: each node moves to its neighbour (or itself) of least hashed priority, links are
    relabelled and made distinct.  A star is done after two rounds; priorities have nothing to do with the ids, so
    long chains shrink by a constant factor in each.
    Every round is joins and a map-side combined aggregate; nothing is collected and a star's centre, however
    many links it has, is only ever aggregated or the large side of a splittable join.  What a round leaves is deleted
    when nothing reads it any more; the result is a staged table.  links should be staged too: they are counted.
    """
    spark = links.sparkSession
    schema = links.schema[a].dataType
    edges = staging.staged(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), links.count())
    levels: list[DataFrame] = []
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(1)).alias("p"), F.col(c).alias("v"))
    while n := edges.count():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("v"), F.least(F.col("m"), rank("a"))["v"].alias("to"))
        best = staging.staged(best, 2 * n)
        levels.append(best)
        step = edges.join(best.select(F.col("v").alias("a"), F.col("to").alias("ta")), "a").join(best.select(F.col("v").alias("b"), F.col("to").alias("tb")), "b")
        left = staging.staged(step.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), n)
        staging.discard(edges)
        edges = left
    staging.discard(edges)
    if not levels:
        return spark.createDataFrame([], T.StructType([T.StructField("node", schema), T.StructField("component_id", schema)]))
    n = levels[0].count()
    roots = levels[0].select(F.col("v").alias("node"), F.col("to").alias("root"))
    for up in levels[1:]:
        roots = roots.join(up.select(F.col("v").alias("root"), F.col("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    roots = staging.staged(roots, n)
    staging.discard(*levels)
    # apart from the join, in whose stage it would bind a hot root to one task
    least = staging.staged(roots.groupBy("root").agg(F.min("node").alias("component_id")), n)
    out = staging.staged(roots.join(least, "root").select("node", "component_id"), n)
    staging.discard(roots, least)
    return out
