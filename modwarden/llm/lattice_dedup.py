"""Near-duplicate vectors by E8 lattice hashing and exact cosine.

Each of `TABLES` tables projects a unit vector onto two random orthonormal groups of eight axes, scales it and decodes
each group to points of the E8 lattice: the nearest of D8 and of D8 shifted by one half, and in either the
runner-up.  A vector is filed under its nearest pair of points and under the pairs with the nearest
neighbours of each.  Vectors filed together are compared by cosine in double precision.

1. Equal vectors form a class (a node) that is compared once and counted by its size.
2. Cores: in a cell of `DENSE` nodes or more, nodes are compared with one pivot of the cell.  Two nodes within half the
   threshold's angle of one vector are linked by the triangle inequality, so the links inside a core are
   counted from its size and never looked at, however dense a group is.
3. Cells that hold more than one core or node apart go on.  A cell of more than `CHUNK` nodes is cut into chunks: of its
   largest core, and of the rest; pairs of chunks that hold the rest are groups.  Cells ship one byte a
   dimension and an error bound, which leave no link out, to find the nodes that may have a link there.
4. Only those nodes' vectors follow.  A pair that meets in several cells counts in the least of them only.  Links
   are counted where they are found and never listed; only what joins components leaves a group.

The pairs of a dense group that is wider than a core are all compared: that part grows with the square of the group,
spread over tasks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modwarden import staging
from modwarden.llm import common
from modwarden.llm.shingles import mixed

TABLES, SCALE, PROBES, SEED = 10, 1.4, 2, 11
#: Nodes of one cell that a task compares at a time, and nodes from which a cell has a pivot.
CHUNK, DENSE = 512, 16
#: Groups of up to so many rows are compared side by side.
SMALL = 48
#: Rows that one task of a comparison takes, about.
TASK_ROWS = 20_000


def _d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest point of D8 (whole numbers of even sum) to each row and the runner-up by turning two coordinates."""
    near = np.rint(x)
    off = x - near
    turn = np.where(off >= 0, 1.0, -1.0)
    order = np.argsort(-np.abs(off), axis=1, kind="stable")
    rows = np.arange(len(x))
    odd = (near.sum(axis=1) % 2) != 0
    first, second = near.copy(), near.copy()
    a, b = order[:, 0], order[:, 1]
    first[rows[odd], a[odd]] += turn[rows[odd], a[odd]]
    second[rows[odd], b[odd]] += turn[rows[odd], b[odd]]
    even = ~odd
    second[rows[even], a[even]] += turn[rows[even], a[even]]
    second[rows[even], b[even]] += turn[rows[even], b[even]]
    return first, second


def e8_points(x: np.ndarray, probes: int) -> np.ndarray:
    """The `probes` nearest of four candidate points of E8 to each row, nearest first, doubled to whole numbers."""
    a, b = _d8(x)
    c, d = _d8(x - 0.5)
    all_ = np.stack((a, b, c + 0.5, d + 0.5), axis=1)
    far = ((all_ - x[:, None, :]) ** 2).sum(axis=2)
    order = np.argsort(far, axis=1, kind="stable")[:, :probes]
    return (2 * np.take_along_axis(all_, order[:, :, None], axis=1)).astype(np.int64)


def axes(dim: int, tables: int, seed: int) -> np.ndarray:
    """For each table two groups of eight orthonormal axes (fewer dimensions are padded)."""
    rng = np.random.default_rng(seed)
    wide = max(dim, 16)
    return np.stack([np.linalg.qr(rng.standard_normal((wide, wide)))[0][:dim, :16] for _ in range(tables)])


def cell_keys(unit: np.ndarray, tables: int = TABLES, scale: float = SCALE, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, tables, cells) keys; equal keys mean a shared cell."""
    n, dim = unit.shape
    stretch = scale * np.sqrt(max(dim, 16) / 8.0)
    out = []
    for t, ax in enumerate(axes(dim, tables, seed)):
        flat = unit @ ax * stretch
        halves = []
        for k in (0, 8):
            points = e8_points(flat[:, k : k + 8], probes)
            h = np.full(points.shape[:2], np.uint64(2 * t + 1 + k), dtype=np.uint64)
            for c in range(8):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + points[:, :, c].view(np.uint64))
            halves.append(h)
        one, two = halves
        pairs = [(0, 0)] + [(i, 0) for i in range(1, probes)] + [(0, i) for i in range(1, probes)] + [(1, 1)]
        out.append(np.stack([mixed(one[:, i] * np.uint64(3) + two[:, j]) for i, j in pairs], axis=1))
    return np.stack(out, axis=1).view(np.int64)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _packed(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte a dimension, the scale of each row, and how far the row is from what the bytes say."""
    scale = np.abs(unit).max(axis=1) / 127.0
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    off = np.sqrt(((unit - small * scale[:, None]) ** 2).sum(axis=1))
    return small, scale, off + 1e-9


_PREPARED = "id long, cls binary, wide boolean, vec binary, keys array<long>, small binary, scale double, off double"


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id; class digest, raw vector, cell keys and bytes, null where the vector links with nothing."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        n = len(ids)
        edge = np.asarray(lists.offsets)
        values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
        size = np.where(np.asarray(lists.is_valid()), np.diff(edge), 0)
        cls, vec, keys, small = ([None] * n for _ in range(4))
        wide, scale, off = [None] * n, [None] * n, [None] * n
        for dim in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == dim)
            m = values[edge[at][:, None] + np.arange(dim)]
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.sqrt((m * m).sum(axis=1))
            good = np.isfinite(m).all(axis=1) & np.isfinite(norm) & (norm > 0)
            at, m = at[good], m[good]
            if not len(at):
                continue
            u = _unit(m)
            k = mixed(cell_keys(u).reshape(len(m), -1).view(np.uint64) + np.uint64(dim)).view(np.int64)
            b, s, o = _packed(u)
            with np.errstate(over="ignore"):
                thin = m.astype(np.float32)
            big = (thin != m).any(axis=1)
            for j, i in enumerate(at.tolist()):
                cls[i], keys[i], small[i], scale[i], off[i] = hashlib.blake2b(m[j].tobytes(), digest_size=16).digest(), k[j], b[j].tobytes(), s[j], o[j]
                wide[i], vec[i] = bool(big[j]), (m[j] if big[j] else thin[j]).tobytes()
        columns = [ids, pa.array(cls, pa.binary()), pa.array(wide, pa.bool_()), pa.array(vec, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(small, pa.binary()), pa.array(scale, pa.float64()), pa.array(off, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "cls", "wide", "vec", "keys", "small", "scale", "off"])


def _vectors(wide, vec) -> np.ndarray:
    """Unit vectors, one a row, of raw ones."""
    if not any(wide):
        return _unit(np.frombuffer(b"".join(vec), np.float32).reshape(len(vec), -1).astype(np.float64))
    return _unit(np.stack([np.frombuffer(v, np.float64 if w else np.float32).astype(np.float64) for w, v in zip(wide, vec)]))


def _near(v: np.ndarray, bar: Callable, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs x < y of one group (part), of different labels and, where a group is two chunks, of different ones, whose
    products reach bar(x, y).  Small groups are compared side by side, each row with the one some rows on."""
    part, label, at = (rows[c].to_numpy() for c in ("part", "label", "at"))
    one = at == rows["other"].to_numpy()
    edge = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
    size = np.diff(edge)
    small = np.repeat(size <= SMALL, size)
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, int(size[size <= SMALL].max(initial=0))):
        i = np.flatnonzero(small[:-d] & (part[d:] == part[:-d]) & (label[d:] != label[:-d]) & (one[:-d] | (at[d:] != at[:-d])))
        i = i[np.einsum("ij,ij->i", v[i], v[i + d]) >= bar(i, i + d)]
        xs.append(i)
        ys.append(i + d)
    for lo, hi in zip(edge[:-1][size > SMALL].tolist(), edge[1:][size > SMALL].tolist()):
        for k in range(lo, hi, 256):
            i, j = np.arange(k, min(k + 256, hi)), np.arange(k, hi)
            x, y = np.nonzero(v[i] @ v[j].T >= bar(i[:, None], j[None, :]))
            x, y = i[x], j[y]
            ok = (x < y) & (label[x] != label[y]) & (one[x] | (at[x] != at[y]))
            xs.append(x[ok])
            ys.append(y[ok])
    return np.concatenate(xs), np.concatenate(ys)


def _of_one_dimension(frames: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """Whole groups, many at a time, whose vectors have one length."""
    for block in common.group_blocks(frames, "part"):
        size = block[column].map(len)
        for n in size.unique():
            yield block[size == n] if (size != n).any() else block


def _maybe(least: float):
    """Of each group of a cell, the nodes that may be linked with one of another core."""

    def run(frames):
        for rows in _of_one_dimension(frames, "small"):
            v = np.frombuffer(b"".join(rows["small"]), np.int8).reshape(len(rows), -1).astype(np.float32) * rows["scale"].to_numpy(np.float32)[:, None]
            off = rows["off"].to_numpy()
            # single precision and the bytes are off by less than what the bar is lowered by
            hit = np.unique(np.concatenate(_near(v, lambda i, j: least - (off[i] + off[j] + off[i] * off[j] + 1e-5), rows)))
            if len(hit):
                yield rows.iloc[hit][["part", "cell", "node", "label", "at", "other"]]

    return run


def _counted_here(keys: np.ndarray, x: np.ndarray, y: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether a pair's `cell` is the first, by table and then by key, of the cells that rows x and y share."""
    out = np.zeros(len(x), dtype=bool)
    live = np.arange(len(x))
    far = np.iinfo(np.int64).max
    for t in range(TABLES):
        a, b = keys[x[live], t], keys[y[live], t]
        first = np.where(a[:, :, None] == b[:, None, :], a[:, :, None], far).min(axis=(1, 2))
        met = first != far
        out[live[met]] = first[met] == cell[live[met]]
        live = live[~met]
        if not len(live):
            break
    return out


def _linked(least: float):
    """Of each group of a cell: links between cores counted by node, and pairs that join components (count 0)."""

    def run(frames):
        for rows in _of_one_dimension(frames, "small"):
            node, label, size, cell = (rows[c].to_numpy() for c in ("node", "label", "copies", "cell"))
            keys = np.stack(rows["keys"].to_list()).reshape(len(rows), TABLES, -1)
            x, y = _near(_vectors(rows["wide"], rows["vec"]), lambda i, j: least, rows)
            own = np.concatenate([_counted_here(keys, x[k : k + 20_000], y[k : k + 20_000], cell[x[k : k + 20_000]]) for k in range(0, len(x), 20_000)] or [np.zeros(0, bool)])
            x, y = x[own], y[own]
            if not len(x):
                continue
            sums = np.bincount(x, weights=size[y], minlength=len(rows)) + np.bincount(y, weights=size[x], minlength=len(rows))
            hit = np.flatnonzero(sums)
            yield pd.DataFrame({"a": node[hit], "b": pd.array([None] * len(hit), dtype="Int64"), "n": sums[hit].astype(np.int64)})
            top = {c: c for c in label[np.unique(np.concatenate((x, y)))].tolist()}

            def find(c):
                while top[c] != c:
                    top[c] = top[top[c]]
                    c = top[c]
                return c

            joined = []
            for u, v in zip(x.tolist(), y.tolist()):
                ru, rv = find(int(label[u])), find(int(label[v]))
                if ru != rv:
                    top[max(ru, rv)] = min(ru, rv)
                    joined.append((int(node[u]), int(node[v]), 0))
            yield pd.DataFrame(joined, columns=["a", "b", "n"]).astype({"b": "Int64"})

    return run


def _cores(dense: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(node, label) of the nodes in cores of at least two: label is the pivot that the core lies around."""
    half = float(np.cos(np.arccos(min(1.0, least)) / 2)) + 1e-9

    @F.pandas_udf(T.BooleanType())
    def near(w: pd.Series, a: pd.Series, x: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        same = a.map(len) * (2 - w.astype(int)) == b.map(len) * (2 - x.astype(int))
        out = np.zeros(len(a), dtype=bool)
        for size in a[same].map(len).mul(2 - w[same].astype(int)).unique():
            own = np.flatnonzero(same & (a.map(len) * (2 - w.astype(int)) == size))
            out[own] = (_vectors(w.iloc[own], a.iloc[own]) * _vectors(x.iloc[own], b.iloc[own])).sum(axis=1) >= half
        return pd.Series(out)

    pairs = dense.where("node <> pivot").select("node", "pivot").distinct()
    side = lambda c, w, v: nodes.select(F.col("node").alias(c), F.col("wide").alias(w), F.col("vec").alias(v))
    both = pairs.join(side("node", "w", "a"), "node").join(side("pivot", "x", "b"), "pivot").where(near("w", "a", "x", "b"))
    # of several pivots that of least priority, which is one order for all cells, so that a dense group has few cores
    taken = staging.staged(both.groupBy("node").agg(F.min(F.struct(F.xxhash64("pivot").alias("p"), F.col("pivot").alias("label")))["label"].alias("label")))
    heads = taken.select("label").distinct().join(taken.select(F.col("node").alias("label")), "label", "left_anti")
    return staging.staged(taken.unionByName(heads.select(F.col("label").alias("node"), "label")))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per vector: id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.  Vectors of
    different dimensions are never compared.  Equal vectors are linked with each other, rows that repeat another row
    and rows with a null id included; a null id is the smallest of a component only if there is no other, and
    component_id is then null.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    staging.small_batches(spark)
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    prepared = staging.staged(source.mapInArrow(_prepared, _PREPARED))
    total, cells_each = prepared.count(), TABLES * PROBES**2
    some = prepared.where("cls is not null")
    body = some.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"), F.first(F.struct("wide", "vec", "keys", "small", "scale", "off")).alias("b"))
    # class numbers are fixed by being written
    nodes = staging.staged(body.select(F.monotonically_increasing_id().alias("node"), "cls", "copies", "first", "b.*"))
    filed = nodes.select("node", F.explode(F.array_distinct("keys")).alias("cell"))
    pivot = F.min(F.struct(F.xxhash64("node").alias("p"), F.col("node").alias("v")))["v"].alias("pivot")
    cells = staging.staged(filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), pivot).where("n > 1"), cells_each * total // 2)
    members = staging.staged(filed.join(cells, "cell"), cells_each * total)
    cores = _cores(members.where(F.col("n") >= DENSE), nodes, least)
    named = staging.staged(members.select("cell", "node").join(cores, "node", "left").select("cell", "node", F.coalesce("label", "node").alias("label")), members.count())

    sizes = named.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("cell").agg(F.sum("m").alias("n"), F.max(F.struct("m", "label")).alias("most")).where("n > most.m")
    whole = F.col("n") <= CHUNK
    rest = F.when(whole, F.lit(1)).otherwise(F.ceil((F.col("n") - F.col("most.m")) / CHUNK)).cast("int")
    core = F.when(whole, F.lit(0)).otherwise(F.ceil(F.col("most.m") / CHUNK)).cast("int")
    open_ = staging.staged(sizes.select("cell", F.col("most.label").alias("top"), rest.alias("rest"), core.alias("core"), (F.col("n") * F.col("rest") + (F.col("n") - F.col("most.m")) * F.col("core")).alias("rows")), members.count())
    tasks = common.tasks_for(spark, open_.agg(F.sum("rows")).first()[0] or 0, TASK_ROWS)
    rows = named.join(open_, "cell")
    inside = (F.col("core") > 0) & (F.col("label") == F.col("top"))
    mix = F.xxhash64("node", F.lit(5))
    rows = rows.withColumn("at", F.when(inside, F.col("rest") + F.pmod(mix, F.greatest("core", F.lit(1)))).otherwise(F.pmod(mix, F.col("rest"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("rest")).otherwise(F.col("rest") + F.col("core")) - 1)))
    rows = rows.withColumn("part", F.xxhash64("cell", F.least("at", "other"), F.greatest("at", "other"))).select("part", "cell", "node", "label", "at", "other")
    shipped = rows.join(nodes.select("node", "small", "scale", "off"), "node").repartition(tasks, "part").sortWithinPartitions("part")
    involved = staging.staged(shipped.mapInPandas(_maybe(least), "part long, cell long, node long, label long, at int, other int"))
    tasks = common.tasks_for(spark, involved.count(), TASK_ROWS)
    shipped = involved.join(nodes.select("node", "wide", "vec", "keys", "small", "copies"), "node").repartition(tasks, "part").sortWithinPartitions("part")
    found = staging.staged(shipped.mapInPandas(_linked(least), "a long, b long, n long"))

    degree = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("node"), "n")
    sums = cores.join(nodes.select("node", "copies"), "node").groupBy("label").agg(F.sum("copies").alias("all"), F.min("node").alias("head"))
    sums = staging.staged(sums, total)
    cored = staging.staged(cores.join(sums, "label").select("node", "all", "head"))
    links = found.where("b is not null").select("a", "b").unionByName(cored.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")))
    comps = common.components(links)
    out = nodes.select("node", "cls", "first", "copies").join(degree, "node", "left").join(cored, "node", "left").join(comps, "node", "left")
    n_links = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("all"), F.col("copies")) - 1
    out = staging.staged(out.select("cls", "first", F.coalesce("component_id", "node").alias("top"), n_links.cast("long").alias("n_links")).where("n_links > 0"), total)
    least_id = staging.staged(out.groupBy("top").agg(F.min("first").alias("component_id")), out.count())
    target = staging.staged(out.join(least_id, "top").select("cls", "n_links", "component_id"), out.count())
    staging.discard(nodes, cells, members, cores, sums, named, open_, involved, found, cored, comps, out, least_id)
    final = prepared.select("id", "cls").join(target, "cls", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return final.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
