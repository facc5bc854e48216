"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation on whole shingle sets.

1. Documents with one shingle set form a class; a class is a node, known by a 128-bit digest of its set.
2. A class has `SAMPLES` MinHash samples.  `BANDS` bands of four make bucket keys; two sets of similarity 0.8
   share no bucket with a chance of (1 - 0.8^4)^32 = 5e-8.
3. The samples fold into a parity bitmap of `BITS` bits (an odd sketch).  The population count of the XOR of two
   sketches estimates their similarity with a standard error of about 0.037 at 0.8; pairs that it puts more than
   `SLACK` below the threshold are not looked at further.  The exact distribution puts a pair of similarity 0.8 there
   with a chance of 2.2e-8, below that of the bands.
4. Pivot rounds: each node is compared on full sets with the most similar pivot among those of its buckets.
   That is linear in the nodes and already joins most of a large group.
5. What remains are buckets whose nodes lie in several components.  Large ones are cut into chunks and every pair
   of chunks is a group of its own.  A group compares sketches, then confirms plausible pairs of different
   components on full sets, most similar first, leaving out pairs that confirmed links already join.
   So every plausible pair is confirmed, refuted or already joined; there is no cap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modwarden import staging
from modwarden.llm import common
from modwarden.llm.shingles import mixed, shingle_set

SAMPLES, BANDS, BITS = 128, 32, 512
SLACK = 0.25
PIVOT_ROUNDS = 2
#: Nodes of one bucket that are compared in one task at a time, and shingles that these may hold, about.
CHUNK, CHUNK_SHINGLES = 400, 4_000_000
#: Rows that one task of a comparison takes, about, and rows and shingles of one that confirms on whole sets.
TASK_ROWS, SET_ROWS, SET_SHINGLES = 8_000, 2_500, 1_000_000
#: Up to so many wanted rows (8 bytes each) are sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

_seeds = mixed(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _ODD = _seeds[:SAMPLES], _seeds[SAMPLES:] | np.uint64(1)
_PLACE = mixed(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(1 << 40))


def samples(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of SAMPLES functions over a set; memory does not grow with the set."""
    low = np.full(SAMPLES, np.uint64(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
    for k in range(0, len(hashes), 1024):
        block = (hashes[k : k + 1024, None] ^ _XOR[None, :]) * _ODD[None, :]
        np.minimum(low, block.min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A key for each band; the band's number is part of it."""
    rows = low.reshape(BANDS, -1)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def odd_sketch(low: np.ndarray) -> bytes:
    """The parity of the samples that fall on each bit."""
    bit = (mixed(low ^ _PLACE) % np.uint64(BITS)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=BITS) & 1).tobytes()


def estimated(xor_count: np.ndarray) -> np.ndarray:
    """Similarity from the bits in which two odd sketches differ."""
    inside = np.maximum(1.0 - 2.0 * xor_count / BITS, 1e-9)
    return 1.0 + BITS / (4.0 * SAMPLES) * np.log(inside)


def _bits(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), BITS // 64)


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _prepared(width: int, with_sketch: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sets = [shingle_set(t, width) for t in texts]
            node = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
            if not with_sketch:
                yield pa.RecordBatch.from_arrays([node, pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "members"])
                continue
            lows = [samples(s) if len(s) else None for s in sets]
            keys = [band_keys(x) if x is not None else np.zeros(0, np.int64) for x in lows]
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            sketch = pa.array([odd_sketch(x) if x is not None else None for x in lows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([len(s) for s in sets], pa.int64()), node, bands, sketch], ["id", "k1", "k2", "n_shingles", "node", "bands", "sketch"])

    return run


@F.pandas_udf(T.DoubleType())
def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    return pd.Series(estimated(np.bitwise_count(_bits(a.tolist()) ^ _bits(b.tolist())).sum(axis=1, dtype=np.int64)))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are alike enough."""

    @F.pandas_udf(T.BooleanType())
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b)], dtype=bool)

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("members").alias("sb")), "b")
    return both.where(alike("sa", "sb")).select("a", "b")


def _plausible(group: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of different components whose sketches and set sizes allow a link, and their estimates."""
    bits, comp, n = _bits(group["sketch"].tolist()), group["comp"].to_numpy(), group["n"].to_numpy()
    codes = pd.factorize(comp)[0]
    found = []
    for i in range(len(group) - 1):
        other = np.flatnonzero(codes[i + 1 :] != codes[i]) + i + 1
        if not len(other):
            continue
        est = estimated(np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64))
        ok = (est >= percent / 100 - SLACK) & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))
        found.append((np.full(int(ok.sum()), i), other[ok], est[ok]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(float)
    return tuple(np.concatenate(x) for x in zip(*found))


def _involved(percent: int):
    """Of each group, the nodes with a plausible partner, under a name that equal groups share."""

    def run(frames):
        seen: set[bytes] = set()
        for group in common.whole_groups(frames, "part"):
            group = group.sort_values("node")
            a, b, _ = _plausible(group, percent)
            if not len(a):
                continue
            some = group.iloc[np.unique(np.concatenate((a, b)))]
            name = hashlib.blake2b(some["node"].to_numpy(np.int64).tobytes(), digest_size=16).digest()
            if name not in seen:
                seen.add(name)
                yield some[["node", "comp", "n", "sketch"]].assign(name=name)

    return run


def _resolved(percent: int):
    """Confirmed links that join the components of a group."""

    def run(frames):
        for group in common.whole_groups(frames, "name"):
            group = group.drop_duplicates("node")
            a, b, est = _plausible(group, percent)
            top = {c: c for c in pd.factorize(group["comp"])[0].tolist()}
            code = pd.factorize(group["comp"])[0].tolist()

            def find(x):
                while top[x] != x:
                    top[x] = top[top[x]]
                    x = top[x]
                return x

            sets = [np.frombuffer(x, np.uint64) for x in group["members"]]
            nodes, out = group["node"].tolist(), []
            for k in np.argsort(-est, kind="stable").tolist():
                i, j = int(a[k]), int(b[k])
                ri, rj = find(code[i]), find(code[j])
                if ri != rj and _alike(sets[i], sets[j], percent):
                    top[ri] = rj
                    out.append((nodes[i], nodes[j]))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _labelled(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """nodes with comp, the component's node or the node itself."""
    return nodes.join(comps.select("node", F.col("component_id").alias("__c")), "node", "left").withColumn("comp", F.coalesce("__c", "node")).drop("__c")


def link_classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(documents with id, the text's key k1 and k2, n_shingles and node; node -> component node, for nodes with a
    confirmed link).  Both are staged tables; what else was staged is deleted."""
    spark = docs.sparkSession
    staging.small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    key = common.content_key(F.col("text"))
    prepared = staging.staged(source.withColumns({"k1": key["h1"], "k2": key["h2"]}).mapInArrow(_prepared(width, True), "id long, k1 long, k2 long, n_shingles long, node binary, bands array<long>, sketch binary"))
    total = prepared.count()
    out = staging.staged(prepared.select("id", "k1", "k2", "n_shingles", "node"))
    # a class goes by a number, which being written fixes; bucket rows are a key and a number
    own = F.first(F.struct(F.col("n_shingles").alias("n"), "sketch", "bands")).alias("x")
    classes = staging.staged(prepared.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), own).select(F.col("node").alias("digest"), F.monotonically_increasing_id().alias("node"), "id", "x.*"))
    staging.discard(prepared)
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    pivots = [F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("p"), F.col("node").alias("v")))["v"].alias(f"pivot{r}") for r in range(PIVOT_ROUNDS)]
    shared = staging.staged(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), *pivots).where("size > 1"), BANDS * total // 2)
    members = staging.staged(buckets.join(shared, "bucket"), BANDS * total)
    wanted = members.select("node").distinct()
    nodes = staging.staged(classes.drop("bands").join(wanted, "node", "left_semi"))
    names = staging.staged(classes.select("node", "digest"), total)
    staging.discard(classes, shared)
    ids = nodes.select("id").distinct()
    if nodes.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = source.join(ids, source["id"].eqNullSafe(ids["id"]), "left_semi")
    sets = texts.select("id", "text").mapInArrow(_prepared(width, False), "digest binary, members binary")
    sets = staging.staged(sets.join(nodes.select("digest", "node"), "digest").dropDuplicates(["node"]).select("node", "members"))

    confirmed: list[DataFrame] = []
    comps = nodes.select("node", F.col("node").alias("component_id")).limit(0)
    for r in range(PIVOT_ROUNDS):
        pairs = members.where(F.col("node") != F.col(f"pivot{r}")).select(F.col("node").alias("a"), F.col(f"pivot{r}").alias("b")).distinct()
        if r:
            label = lambda c: comps.select(F.col("node").alias(c), F.col("component_id").alias(f"c{c}"))
            pairs = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        scored = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").withColumn("est", _estimate("sa", "sb")).where(F.col("est") >= percent / 100 - SLACK)
        best = staging.staged(scored.groupBy("a").agg(F.max(F.struct("est", "b"))["b"].alias("b")), total)
        confirmed.append(staging.staged(_confirmed(best, sets, percent), 16 * best.count()))
        staging.discard(best, comps)
        comps = common.components(reduce(DataFrame.unionByName, confirmed))

    placed = _labelled(members.select("bucket", "node"), comps)
    open_ = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    # a table of its own: an aggregate in the stage of the join would bind a hot bucket to one task
    open_ = staging.staged(open_, members.count())
    rows = staging.staged(placed.join(open_, "bucket").join(nodes.select("node", "n", "sketch"), "node"), 4 * members.count())
    staging.discard(members, comps, open_)
    # a chunk is bounded by its nodes and, as their whole sets may follow, by what those hold
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int")
    cut = staging.staged(rows.groupBy("bucket").agg(chunks.alias("chunks"), F.count(F.lit(1)).alias("size")), rows.count())
    tasks = common.tasks_for(spark, cut.agg(F.sum(F.col("size") * F.col("chunks"))).first()[0] or 0, TASK_ROWS)
    parts = rows.join(cut.drop("size"), "bucket")
    at = F.pmod(F.xxhash64("node", F.lit(99)), F.col("chunks")).cast("int")
    parts = parts.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    parts = parts.withColumn("part", F.xxhash64("bucket", F.least("at", "other"), F.greatest("at", "other"))).select("part", "node", "comp", "n", "sketch")
    involved = parts.repartition(tasks, "part").sortWithinPartitions("part").mapInPandas(_involved(percent), "node long, comp long, n long, sketch binary, name binary")
    involved = staging.staged(involved.dropDuplicates(["name", "node"]))
    size = involved.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).first()
    tasks = max(common.tasks_for(spark, size["rows"], SET_ROWS), common.tasks_for(spark, size["n"] or 0, SET_SHINGLES))
    confirmed.append(staging.staged(involved.join(sets, "node").repartition(tasks, "name").sortWithinPartitions("name").mapInPandas(_resolved(percent), "a long, b long")))
    staging.discard(rows, cut, involved, sets, nodes)
    comps = common.components(reduce(DataFrame.unionByName, confirmed))
    named = comps.join(names, "node").join(names.select(F.col("node").alias("component_id"), F.col("digest").alias("top")), "component_id")
    linked = staging.staged(named.select(F.col("digest").alias("node"), F.col("top").alias("component_id")), comps.count())
    staging.discard(comps, names, *confirmed)
    return out, linked


def _tops(classes: DataFrame, comps: DataFrame, least: Column, most: int) -> DataFrame:
    """Of the classes (`most` at most) that have copies or links, (node, least): the least `first` of their components."""
    moved = staging.staged(classes.join(comps, "node", "left").where("copies > 1 or component_id is not null").select("node", F.coalesce("component_id", "node").alias("top"), "first"), most)
    first = staging.staged(moved.groupBy("top").agg(least), moved.count())  # apart from the join, for hot components
    out = staging.staged(moved.join(first, "top").drop("top", "first"), moved.count())
    staging.discard(moved, first)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links), kept.

    A link holds where 100 * |intersection| >= percent * |union| of the distinct shingles of `width` words.  Texts
    without words (or null) link with nothing and stay.  Rows of equal text are linked; rows that also share their
    id are all kept.  A null id is never the smallest id of a component that has others.  An empty table gives an
    empty result, other columns are left out.
    """
    rows, comps = link_classes(docs, id_col, text_col, width, percent)
    classes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    target = _tops(classes, comps, F.min("first").alias("component_id"), rows.count())
    staging.discard(comps)
    out = rows.join(target, "node", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns as they were, that stand alone, and one of each group of linked rows.

    That is a row of the smallest id; a null id is the smallest only among null ones, and of several texts of that id
    the one of least key stays.  Rows are known by id and text, so a null or repeated id goes only with the texts that
    are copies.  Texts without words stay, each of them.
    """
    columns = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    id_at, text_at = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    rows, comps = link_classes(plain, id_at, text_at, width, percent)
    own = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
    classes = rows.where("node is not null").groupBy("node").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("copies"))
    winners = _tops(classes, comps, F.min("first").alias("w"), rows.count())
    linked = rows.join(winners, "node")
    stays = F.col("id").eqNullSafe(F.col("w.id")) & (F.col("k1") == F.col("w.k1")) & (F.col("k2") == F.col("w.k2"))
    # rows that go (n = 0), and those of which one of several equal ones stays
    acts = staging.staged(linked.groupBy("id", "k1", "k2").agg(F.max(F.when(stays, F.lit(1)).otherwise(F.lit(0))).alias("stay"), F.count(F.lit(1)).alias("n")).where("stay = 0 or n > 1").select("id", "k1", "k2", "stay"), rows.count())
    staging.discard(rows, comps, winners)
    key = common.content_key(F.col(text_at).cast("string"))
    left = plain.withColumns({"__id": F.col(id_at).cast("long"), "__k1": key["h1"], "__k2": key["h2"]})
    twice = acts.where("stay = 1")

    def joined(some: DataFrame, n: int, how: str) -> DataFrame:
        """Texts do not travel where the keys are few enough to be sent to them."""
        some = F.broadcast(some) if n <= BROADCAST_ROWS else some
        same = F.col("__id").eqNullSafe(some["id"]) & (F.col("__k1") == some["k1"]) & (F.col("__k2") == some["k2"])
        return left.join(some, same, how)

    out = joined(acts, acts.count(), "left_anti")
    if n := twice.count():
        out = out.unionByName(joined(twice, n, "left_semi").dropDuplicates(["__id", "__k1", "__k2"]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
