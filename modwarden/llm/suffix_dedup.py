"""Removal of repeated byte strings by suffix arrays of shards, built by induced sorting.

A string of `length` bytes is repeated if it starts at two places of all texts.  To bring its places together:

1. Every window of `length` bytes has an anchor, the 64-byte substring in it of least hash (the rightmost if tied),
   which depends on the window's bytes alone.  Consecutive windows with one anchor form a segment.
2. Anchors that occur at one place only hold nothing repeated and end here.
3. The windows of other segments fall into blocks by their distance from the anchor; all windows of a block share a
   core.  Equal windows agree in anchor, distance and core, so they meet in one group.  Groups of one window run end
   here.
4. Equal contents of a group are counted and kept once.  Of groups with more than `HOT` different contents, one
   place of each content is cut into smaller blocks with longer cores, down to blocks of one window, whose groups
   have one content only.  So a common passage does not gather its surroundings in one task.  Groups are dealt to shards of bounded bytes; a shard's
   contents become one string, its suffix array is built by induced sorting (induced_sort), and a window whose
   permuted common prefix with a neighbouring suffix reaches `length`, or whose content was counted twice, is
   repeated.
5. Spans go back to the texts, which are cut.

Texts are known by 128 bits of hash.  Equal texts are one; a text of at least `length` bytes that occurs
twice is repeated throughout.

The same runs over words in place of bytes (`WORDS`): a symbol is then the 64-bit hash of a word, and `length` and all
places count words, so a passage is found whatever bytes stand between its words.  For the suffix array each word becomes two
symbols of a small alphabet, as a round of sorting takes one symbol.  Where strings of bytes are cut as well, groups that stand
inside those everywhere end before any sorting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modwarden import staging
from modwarden.llm import common
from modwarden.llm.induced_sort import permuted_lcp, suffix_array
from modwarden.llm.shingles import mixed, powers, word_places

#: Windows of a block at each level; the last must be 1 and the first below `length`.
BLOCKS = (128, 16, 1)
WORD_BLOCKS = (24, 6, 1)
#: Different contents of one group that one shard may have to hold.
HOT = 500
SHARD_BYTES = 1_000_000
#: A word is eight bytes of a body and two symbols of a suffix array.
SHARD_WORDS = 200_000
#: Up to so many wanted texts are looked up by a broadcast of their 16-byte keys; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes of texts that one array operation takes together; a longer text is taken alone.
CHUNK_BYTES = 128_000

SPANS = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))
SEGMENT = "anchor long, k1 long, k2 long, at int, lo int, hi int"
PIECE = "grp long, content long, k1 long, k2 long, at int, lo int, hi int, anchor long, pg long, pc long, base int, twice boolean, covered boolean"


@dataclass(frozen=True)
class Symbols:
    """What the symbols of texts are: of their bytes, one text after another, and where texts start and end, the symbols, where
    texts start and end in these, and the first byte and end of each."""

    of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    gram: int
    kind: type


def _bytes_of(raw: np.ndarray, bounds: np.ndarray):
    at = np.arange(len(raw) + 1)
    return raw, bounds, at[:-1], at[1:]


def _words_of(raw: np.ndarray, bounds: np.ndarray):
    start, end, words = word_places(raw, bounds)
    return words, np.searchsorted(start, bounds), start, end


BYTES, WORDS = Symbols(_bytes_of, 64, np.uint8), Symbols(_words_of, 12, np.uint64)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, bounds) of texts that are taken together."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _lists(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(where each row's list starts, the fields of all rows' structs); a null list is empty."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    names = [f.name for f in flat.type]
    return np.concatenate(([0], np.cumsum(size))).astype(np.int64), {n: x.to_numpy(zero_copy_only=False) for n, x in zip(names, flat.flatten())}


def _blocks(symbols: Symbols) -> tuple[int, ...]:
    return WORD_BLOCKS if symbols is WORDS else BLOCKS


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(raw) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1]))), down


def _hash(sums: np.ndarray, down: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of symbols [lo, hi)."""
    return mixed((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def _rightmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the position of its least value, the rightmost if tied."""
    low, reach = h, 1
    while reach < width:
        step = min(reach, width - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    # a value is some window's least if it equals the greatest of the least values of the windows that hold it
    none = np.zeros(width - 1, h.dtype)
    top, reach = np.concatenate((none, low, none)), 1
    while reach < width:
        step = min(reach, width - reach)
        top = np.maximum(top[:-step], top[step:])
        reach += step
    chosen = h == top
    picked = np.flatnonzero(chosen)
    # of each window: the last picked place of that value; picked values inside a window are never below its least
    last = np.cumsum(chosen)[width - 1 :] - 1
    at = picked[last]
    off = np.flatnonzero(h[at] != low)
    while len(off):
        last[off] -= 1
        at[off] = picked[last[off]]
        off = off[h[at[off]] != low[off]]
    return at


def segments_of(raw: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor place, first window, last window, text) of each segment of texts that stand one after another."""
    whole = np.flatnonzero(np.diff(bounds) >= length)
    if not len(whole):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none, none
    sums, down = _sums(raw)
    gram = min(gram, length)
    h = mixed((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1] + np.uint64(gram))
    at = _rightmost_minima((h >> np.uint64(32)).astype(np.uint32), length - gram + 1)
    new = np.ones(len(at) + 1, dtype=bool)
    new[1:-1] = at[1:] != at[:-1]
    new[bounds[whole]] = True
    new[bounds[whole + 1] - length + 1] = True
    edge = np.flatnonzero(new)
    first, last = edge[:-1], edge[1:] - 1
    text = np.searchsorted(bounds, first, "right") - 1
    inside = first + length <= bounds[text + 1]  # other windows reach into the next text
    first, last, text = first[inside], last[inside], text[inside]
    at, start = at[first], bounds[text]
    return h[at], at - start, first - start, last - start, text


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _int(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32), pa.int32())


def _segments(length: int, symbols: Symbols):
    names = ["anchor", "k1", "k2", "at", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, raw, bounds in _chunks(batch.column(2)):
                values, bounds, _, _ = symbols.of(raw, bounds)
                h, at, lo, hi, text = segments_of(values, bounds, length, symbols.gram)
                yield pa.RecordBatch.from_arrays([_long(h), _long(k1[i:j][text]), _long(k2[i:j][text]), _int(at), _int(lo), _int(hi)], names)

    return run


def _merged(run):
    """Puts the many small batches of a function together."""

    def whole(batches):
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 20_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held, b = [], None
        common.release()

    return whole


def _pieces(length: int, block: int, symbols: Symbols):
    """Cuts a text's wanted window runs into blocks: group, content, place, and whether it stands in one of the text's cut spans."""
    names = ["grp", "content", "k1", "k2", "at", "lo", "hi", "anchor", "pg", "pc", "base", "twice", "covered"]

    def run(batches):
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            rows, wanted = _lists(batch.column("wanted"))
            cuts, cut = _lists(batch.column("spans")) if "spans" in batch.schema.names else (None, None)
            for i, j, raw, starts in _chunks(batch.column("text")):
                values, bounds, begin, end = symbols.of(raw, starts)
                sums, down = _sums(values)
                anchor, at, lo, hi, pg, pc, base, twice = (wanted[k][rows[i] : rows[j]].astype(np.int64) for k in ("anchor", "at", "lo", "hi", "pg", "pc", "base", "twice"))
                near, far = (at - hi) // block, (at - lo) // block
                count = far - near + 1
                src = np.repeat(np.arange(len(at)), count)
                text = np.repeat(np.arange(j - i), np.diff(rows[i : j + 1]))[src]
                b = np.repeat(near, count) + np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count)
                a = at[src]
                upper, lower = a - b * block, a - b * block - block + 1
                first, last = np.maximum(lower, lo[src]), np.minimum(upper, hi[src])
                own, stop = bounds[text], bounds[text + 1]
                core = _hash(sums, down, np.maximum(upper, 0) + own, np.minimum(lower + length + own, stop))
                group = mixed(mixed(anchor[src].view(np.uint64) + b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + core)
                content = _hash(sums, down, first + own, last + length + own)
                covered = np.zeros(len(src), dtype=bool)
                if cuts is not None and cuts[j] > cuts[i]:
                    shift = np.repeat(starts[:-1], np.diff(cuts[i : j + 1]))
                    cut_lo, cut_hi = cut["lo"][cuts[i] : cuts[j]] + shift, cut["hi"][cuts[i] : cuts[j]] + shift
                    k = np.searchsorted(cut_lo, begin[first + own], "right") - 1
                    covered = (k >= 0) & (cut_hi[np.maximum(k, 0)] >= end[last + length - 1 + own])
                yield pa.RecordBatch.from_arrays([_long(group), _long(content), _long(k1[i:j][text]), _long(k2[i:j][text]), _int(a), _int(first), _int(last), _long(anchor[src]), _long(pg[src]), _long(pc[src]), _int(base[src]), pa.array(twice[src] > 0), pa.array(covered)], names)

    return run


def _contents(length: int, symbols: Symbols):
    """The symbols of wanted contents, as bytes."""

    def run(batches):
        for batch in batches:
            rows, wanted = _lists(batch.column("wanted"))
            for i, j, raw, bounds in _chunks(batch.column("text")):
                values, bounds, _, _ = symbols.of(raw, bounds)
                w = {k: x[rows[i] : rows[j]] for k, x in wanted.items()}
                own = np.repeat(bounds[:-1], np.diff(rows[i : j + 1]))
                ranges = zip((w["lo"] + own).tolist(), (w["hi"] + length + own).tolist())
                yield pa.RecordBatch.from_arrays(
                    [_long(w["grp"]), _long(w["content"]), pa.array(w["twice"].astype(bool)), pa.array([values[a:b].tobytes() for a, b in ranges], pa.binary())],
                    ["grp", "content", "twice", "body"],
                )

    return run


def repeated_windows(bodies: list[bytes], twice: list[bool], length: int, kind: type = np.uint8) -> list[np.ndarray]:
    """For each body the starts of its windows of `length` symbols that occur at another place of the bodies.

    A body that stands for two places is repeated throughout."""
    values = np.frombuffer(b"".join(bodies), kind).astype(np.int64) if kind == np.uint8 else np.unique(np.frombuffer(b"".join(bodies), kind), return_inverse=True)[1]
    size = np.array([len(b) // np.dtype(kind).itemsize for b in bodies], dtype=np.int64)
    step = 1
    if kind != np.uint8:
        # a word is two symbols, and as no second one is ever a first one, what starts at a word only equals what starts at one
        step, base = 2, int(len(values) and values.max()) ** 0.5 // 1 + 1
        values = np.stack((values // base, values % base + base), 1).astype(np.int64).ravel()
        size, length = size * step, length * step
    start = np.concatenate(([0], np.cumsum(size + 1)))
    joined = np.ones(start[-1] + 1, dtype=np.int64)  # 1 stands between bodies, 0 at the end
    joined[-1] = 0
    inside = np.ones(start[-1], dtype=bool)
    inside[start[1:] - 1] = False
    joined[:-1][inside] = values + 2
    alphabet = int(joined.max()) + 1
    if alphabet < 1 << 16:  # numpy sorts these by radix
        joined = joined.astype(np.uint16)
    sa = suffix_array(joined, alphabet)
    lcp, before = permuted_lcp(joined, sa, length)
    end = np.repeat(start[1:] - 1, size + 1)
    room = np.zeros(len(joined), dtype=np.int64)
    room[:-1] = end - np.arange(len(end))
    long = (lcp >= length) & (room >= length)
    flagged = long.copy()
    flagged[before[np.flatnonzero(long)]] = True
    flagged &= room >= length
    out = []
    for k, dup in enumerate(twice):
        a, n = int(start[k]), int(size[k]) - length + 1
        out.append(np.arange(0, n, step) // step if dup else np.flatnonzero(flagged[a : a + n : step]))
    return out


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal covered ranges of windows starting at sorted places."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    lo = np.concatenate(([starts[0]], starts[cut]))
    hi = np.concatenate((starts[cut - 1], [starts[-1]])) + length
    return list(zip(lo.tolist(), hi.tolist()))


def _shard(length: int, symbols: Symbols):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows([bytes(b) for b in frame["body"]], frame["twice"].tolist(), length, symbols.kind)
        rows = [(g, c, lo, hi) for g, c, starts in zip(frame["grp"], frame["content"], found) for lo, hi in _runs(starts, length)]
        common.release()
        return pd.DataFrame(rows, columns=["grp", "content", "from", "to"])

    return run


def _having(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """texts with the column `wanted` of a staged table, for the keys that have one; other texts do not travel."""
    keys = wanted.select("k1", "k2")
    if wanted.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(keys), ["k1", "k2"], "left_semi")
    return texts.dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"])


def _kinds(pieces: DataFrame) -> DataFrame:
    """The different contents of groups that hold anything repeated and do not stand in cut spans everywhere: whether it stands
    twice, one place, and whether its group is hot."""
    kinds = staging.staged(pieces.groupBy("grp", "content").agg(F.count(F.lit(1)).alias("places"), F.bool_or("twice").alias("twice"), F.bool_and("covered").alias("covered"), F.min(F.struct("k1", "k2", "lo", "hi", "at", "anchor")).alias("one")))
    groups = kinds.groupBy("grp").agg(F.sum("places").alias("all"), F.bool_or("twice").alias("any"), F.bool_and("covered").alias("covered"), F.count(F.lit(1)).alias("contents")).where("(all > 1 or any) and not covered").select("grp", (F.col("contents") > HOT).alias("hot"))
    # a table of their own: an aggregate in the stage of the join would bind a hot group to one task
    groups = staging.staged(groups)
    out = staging.staged(kinds.join(groups, "grp").select("grp", "content", (F.col("twice") | (F.col("places") > 1)).alias("twice"), "one", "hot"))
    staging.discard(kinds, groups)
    return out


def _resolved(texts: DataFrame, kinds: DataFrame, length: int, level: int, symbols: Symbols) -> DataFrame:
    """grp, content, from, to: the covered ranges of each content, counted from its first symbol."""
    last = level + 1 == len(_blocks(symbols))
    cold = kinds if last else kinds.where("not hot")
    total = cold.agg(F.sum(F.col("one.hi") - F.col("one.lo") + length)).first()[0] or 0
    shards = max(1, -(-int(total) // (SHARD_WORDS if symbols is WORDS else SHARD_BYTES)))
    wanted = staging.staged(cold.groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct("grp", "content", "twice", F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"))).alias("wanted")))
    bodies = _having(texts, wanted).mapInArrow(_merged(_contents(length, symbols)), "grp long, content long, twice boolean, body binary")
    found = staging.staged(bodies.groupBy(F.pmod(F.xxhash64("grp"), F.lit(shards)).alias("shard")).applyInPandas(_shard(length, symbols), "grp long, content long, `from` int, `to` int"))
    staging.discard(wanted)
    hot = kinds.where("hot")
    if last or hot.isEmpty():
        return found
    # only different contents are cut further; their windows' verdicts come back to them as ranges
    one = F.col("one")
    wanted = staging.staged(hot.groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct(one["anchor"].alias("anchor"), one["at"].alias("at"), one["lo"].alias("lo"), one["hi"].alias("hi"), F.col("grp").alias("pg"), F.col("content").alias("pc"), one["lo"].alias("base"), "twice")).alias("wanted")))
    pieces = staging.staged(_having(texts, wanted).mapInArrow(_merged(_pieces(length, _blocks(symbols)[level + 1], symbols)), PIECE))
    staging.discard(wanted)
    kinds = _kinds(pieces)
    below = _resolved(texts, kinds, length, level + 1, symbols)
    up = pieces.join(below, ["grp", "content"]).select(F.col("pg").alias("grp"), F.col("pc").alias("content"), (F.col("lo") - F.col("base") + F.col("from")).alias("lo"), (F.col("lo") - F.col("base") + F.col("to")).alias("hi"))
    whole = up.groupBy("grp", "content").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("raw")).select("grp", "content", F.explode(_disjoint("raw")).alias("s"))
    out = staging.staged(found.unionByName(whole.select("grp", "content", F.col("s.lo").alias("from"), F.col("s.hi").alias("to"))))
    staging.discard(found, pieces, kinds, below)
    return out


def repeated_spans(docs: DataFrame, text_col: str, length: int, symbols: Symbols = BYTES, cut: tuple[DataFrame, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs with k1, k2; per text its repeated ranges of symbols as k1, k2, spans, in order and disjoint).

    cut: the spans of bytes that are cut already, and their law's length.  Ranges of words that lie inside them at all their
    places may then be left out; any other is found at all its places."""
    spark = docs.sparkSession
    staging.small_batches(spark)
    key = common.content_key(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.withColumn("k1", key["h1"]).withColumn("k2", key["h2"])
    # two words take three bytes at least, as words that no space parts have three bytes each
    least = 2 * length - 1 if symbols is WORDS else length
    texts = keyed.select("k1", "k2", F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") >= least)
    segments = staging.staged(texts.mapInArrow(_merged(_segments(length, symbols)), SEGMENT))
    place = F.xxhash64("k1", "k2", "at")
    shared = segments.groupBy("anchor").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("anchor")
    # equal texts have equal segments, of which the set keeps one; a distinct() here would bind a hot anchor to one task, and
    # so would the aggregate of anchors in the stage of the join
    shared = staging.staged(shared)
    left = segments.join(shared, "anchor", "left_semi")
    wanted = left.groupBy("k1", "k2").agg(F.collect_set(F.struct("anchor", "at", "lo", "hi", F.lit(0).cast("long").alias("pg"), F.lit(0).cast("long").alias("pc"), F.lit(0).alias("base"), F.lit(False).alias("twice"))).alias("wanted"))
    wanted = staging.staged(wanted)
    staging.discard(segments, shared)
    if cut is not None:
        bare, wanted = wanted, staging.staged(wanted.join(cut[0].select("k1", "k2", "spans"), ["k1", "k2"], "left"))
        staging.discard(bare)
    pieces = staging.staged(_having(texts, wanted).mapInArrow(_merged(_pieces(length, _blocks(symbols)[0], symbols)), PIECE))
    staging.discard(wanted)
    kinds = _kinds(pieces)
    found = _resolved(texts, kinds, length, 0, symbols)
    spans = pieces.select("grp", "content", "k1", "k2", "lo").join(found, ["grp", "content"]).select("k1", "k2", (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to")).alias("hi"))
    per_text = spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("raw"))
    copies = keyed.where(F.octet_length(text_col) >= least).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length(text_col)).alias("size")).where("n > 1")
    if cut is not None:  # longer copies are cut throughout
        copies = copies.where(F.col("size") < cut[1])
    if symbols is WORDS:  # words are counted in the texts that stand twice only
        copies = _having(texts, staging.staged(copies.select("k1", "k2"))).select("k1", "k2", _n_words(F.col("text")).alias("size")).where(F.col("size") >= length)
    whole = copies.select("k1", "k2", F.array(F.struct(F.lit(0).alias("lo"), F.col("size").cast("int").alias("hi"))).alias("whole"))
    joined = per_text.join(whole, ["k1", "k2"], "full").select("k1", "k2", F.coalesce("whole", _disjoint("raw")).alias("spans"))
    out = staging.staged(joined)
    staging.discard(pieces, kinds, found)
    return keyed, out


@F.pandas_udf(T.IntegerType())
def _n_words(text: pd.Series) -> pd.Series:
    return pd.Series([len(word_places(t.encode("utf-8", "surrogatepass"))[2]) for t in text], dtype="int32")


@F.pandas_udf(SPANS)
def _disjoint(raw: pd.Series) -> pd.Series:
    def one(spans):
        if spans is None:
            return None
        out: list[dict] = []
        for x in spans:
            if out and x["lo"] <= out[-1]["hi"]:
                out[-1]["hi"] = max(out[-1]["hi"], x["hi"])
            else:
                out.append({"lo": x["lo"], "hi": x["hi"]})
        return out

    return raw.map(one)


def _split_join(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """keyed with spans where there are any; texts without travel only if there are too many keys to send."""
    if spans.count() <= BROADCAST_ROWS:
        keys = F.broadcast(spans.select("k1", "k2"))
        cut = keyed.join(keys, ["k1", "k2"], "left_semi").join(spans, ["k1", "k2"])
        return cut.unionByName(keyed.join(keys, ["k1", "k2"], "left_anti"), allowMissingColumns=True)
    return keyed.join(spans, ["k1", "k2"], "left")


def cut_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, words: int | None = None) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, the SHA-256 of the bytes that stay, and `text`, what stays.

    Every byte covered by a string of `length` bytes that also starts elsewhere goes, first places included.
    Null texts count as empty, and `text` stays null.  Rows that repeat another row are copies of its text, whatever
    their ids.  In `text` a character of which only some bytes are covered stays whole.  With `words`, `text` also lacks every
    passage of so many words that stands elsewhere in the texts as given, see without_passages(); the digests do not change.  An empty table gives an empty
    result; other columns are left out.
    """
    plain = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    keyed, spans = repeated_spans(plain, "__text", length)
    kept = _without("__text", "spans")
    if words is not None:
        _, passages = repeated_spans(plain, "__text", words, WORDS, (spans, length))
        both = staging.staged(spans.join(passages.withColumnRenamed("spans", "passages"), ["k1", "k2"], "full"))
        staging.discard(spans, passages)
        spans, kept = both, _without_both("__text", "spans", "passages")
    rows = _split_join(keyed, spans).withColumn("body", F.coalesce("__text", F.lit("")))

    @F.pandas_udf(T.StringType())
    def digest(text: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for t, c in zip(text, cuts):
            body = t.encode("utf-8", "surrogatepass")
            h, at = hashlib.sha256(), 0
            for x in c if c is not None else ():
                h.update(body[at : x["lo"]])
                at = x["hi"]
            h.update(body[at:])
            out.append(h.hexdigest())
        return pd.Series(out, dtype=object)

    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"])
    return rows.select(
        F.col("__id").alias(id_col),
        F.octet_length("body").cast("long").alias("n_bytes"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        digest("body", "spans").alias("kept_sha256"),
        kept.alias("text"),
    ).withColumn("n_spans", F.greatest("n_spans", F.lit(0)))


def _left(body: bytes, cuts: list[tuple[int, int]]) -> str:
    """What stays of a text without ranges of bytes, which may overlap."""
    kept, at = [], 0
    for lo, hi in sorted(cuts):
        kept.append(body[at:lo])
        at = max(at, hi)
    kept.append(body[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def _of_bytes(body: bytes, cuts) -> list[tuple[int, int]]:
    """Ranges of bytes without the characters that are only partly covered; they stay."""
    out = []
    for x in cuts if cuts is not None else ():
        lo, hi = x["lo"], x["hi"]
        while lo < hi and lo < len(body) and body[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(body) and body[hi] & 0xC0 == 0x80:
            hi -= 1
        out.append((lo, hi))
    return out


def _of_words(body: bytes, cuts) -> list[tuple[int, int]]:
    """The bytes of ranges of words."""
    if cuts is None or not len(cuts):
        return []
    start, end, _ = word_places(body)
    return [(int(start[x["lo"]]), int(end[x["hi"] - 1])) for x in cuts]


def _cut(text: pd.Series, *ranges) -> pd.Series:
    out = []
    for i, t in enumerate(text):
        if t is None or all(c.iloc[i] is None or not len(c.iloc[i]) for c, _ in ranges):
            out.append(t)
            continue
        body = t.encode("utf-8", "surrogatepass")
        out.append(_left(body, [r for c, of in ranges for r in of(body, c.iloc[i])]))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, cuts: pd.Series) -> pd.Series:
    return _cut(text, (cuts, _of_bytes))


@F.pandas_udf(T.StringType())
def _without_words(text: pd.Series, cuts: pd.Series) -> pd.Series:
    return _cut(text, (cuts, _of_words))


@F.pandas_udf(T.StringType())
def _without_both(text: pd.Series, cuts: pd.Series, passages: pd.Series) -> pd.Series:
    return _cut(text, (cuts, _of_bytes), (passages, _of_words))


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = 400) -> DataFrame:
    """docs, all columns as they were, with repeated strings of `length` bytes cut from the text.

    A character of which only some bytes are covered stays whole.  Null texts stay null."""
    columns = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    at = f"c{columns.index(text_col)}"
    keyed, spans = repeated_spans(plain, at, length)
    return _split_join(keyed, spans).withColumn(at, _without(F.col(at), F.col("spans"))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def without_passages(docs: DataFrame, text_col: str = "text", words: int = 51) -> DataFrame:
    """docs, all columns as they were, without any passage of `words` words that also stands elsewhere, first places included.

    What stands between the words does not count and goes with them; what stands before and after a passage stays.
    Words are those of shingles.word_places, capitals as they are.  Null texts stay null."""
    columns = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    at = f"c{columns.index(text_col)}"
    keyed, spans = repeated_spans(plain, at, words, WORDS)
    return _split_join(keyed, spans).withColumn(at, _without_words(F.col(at), F.col("spans"))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
