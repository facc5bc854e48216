"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

Words of equal length advance together.  Polynomial hashes of all substrings up to the longest piece probe the
sorted hashes of the pieces; at each position the best piece that ends there is taken by a vectorised maximum
and its length is the backpointer.

For a unigram model the merit of a path is the sum of its pieces' scores.  For a BPE model a sum of scores does not
give the library's segmentation, so the search runs over valid paths instead: a piece may follow another only if
BPE on the two together yields the two.  Exactly one path of pairwise valid neighbours spans each prefix, and it is
the one that merging gives; the maximum picks it.  Validity of a pair walks back through the merges that formed
the two pieces, latest first, and looks for a merge across the border that would have come first.
"""

from __future__ import annotations

import struct
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modwarden import staging
from modwarden.llm.shingles import mixed

#: The character that stands for a space.
META = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.int64(1) << 40
CACHE_WORDS, MEMO = 500_000, 1 << 20
#: Words of one search at a time, in characters.
BATCH_CHARS = 200_000
#: Words of more than LONG characters are searched in windows; a window, a multiple of all short periods, follows a run-up.
WINDOW, RUN_UP, LONG = 10_080, 2_520, 20_160
#: Fixed values of the public model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        elif wire == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if wire == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class Pieces:
    """A model file and its search."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        self.text: list[str] = []
        score, kind, self.model = [], [], UNIGRAM
        self.prefix, self.squeeze = True, True
        for number, value in _fields(model):
            if number == 1:
                p = dict(_fields(value))
                self.text.append(p.get(1, b"").decode("utf-8"))
                score.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kind.append(p.get(3, NORMAL))
            elif number == 2:
                self.model = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2) or self.squeeze:
                    raise ValueError("only models with identity normalisation that keep white space are supported")
        if any(k == USER for k in kind):
            raise ValueError("models with user-defined pieces are not supported")
        self.score, self.kind = np.array(score), np.array(kind)
        self.unknown = int(np.flatnonzero(self.kind == UNKNOWN)[0])
        self.bytes_at = {int(self.text[i][3:5], 16): int(i) for i in np.flatnonzero(self.kind == BYTE)}
        # runs of the space mark join each other last and from the left; they are handled apart
        runs = {len(t): i for i, t in enumerate(self.text) if kind[i] == NORMAL and t and not t.strip(META)}
        self.run_ids = runs
        self.one_mark = runs.get(1)
        usable = [i for i, t in enumerate(self.text) if kind[i] == NORMAL and (t.strip(META) or len(t) == 1)]
        if any(META in self.text[i][1:] for i in usable):
            raise ValueError("only models whose pieces begin at word starts are supported")
        self.longest = max(len(self.text[i]) for i in usable)
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], dtype=np.uint64)
        ids = np.array(usable, dtype=np.int64)
        hashes = np.array([self._hash(self.text[i]) for i in usable], dtype=np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], ids[order]
        self.length = np.array([len(t) for t in self.text], dtype=np.int64)
        by_score = np.argsort(-self.score, kind="stable")
        self.rank = np.empty(len(self.text), dtype=np.int64)
        self.rank[by_score] = np.arange(len(self.text))
        self.rank[self.length <= 1] = -1
        if self.model == BPE:
            self._merges(usable)
        elif self.model != UNIGRAM:
            raise ValueError("only unigram and BPE models are supported")
        self.worst = float(self.score[usable].min()) - 10.0
        raw = [bytes([int(t[3:5], 16)]) if kind[i] == BYTE else b"" if kind[i] == CONTROL else t.replace(META, " ").encode("utf-8") for i, t in enumerate(self.text)]
        raw[self.unknown] = " ⁇ ".encode()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(b) for b in raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.words: dict[str, bytes] = {}
        self.long: dict[str, bytes] = {}

    def _hash(self, piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return mixed(np.array([h + len(piece)], dtype=np.uint64))[0]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.ids[at], -1)

    def _merges(self, usable: list[int]) -> None:
        """All ways to join two pieces into one, and of each piece the two that merging forms it from."""
        known = {self.text[i]: i for i in usable}
        splits = sorted((len(self.text[i]), i, known[self.text[i][:k]], known[self.text[i][k:]]) for i in usable for k in range(1, len(self.text[i])) if self.text[i][:k] in known and self.text[i][k:] in known)
        size, whole, left, right = (np.array(x, dtype=np.int64) for x in zip(*splits))
        key = (left << 24) | right
        order = np.argsort(key)
        self.join_key, self.join_rank = key[order], self.rank[whole][order]
        self.left, self.right = np.full(len(self.text), -1, np.int64), np.full(len(self.text), -1, np.int64)
        self.reached = self.length == 1
        self.memo_key, self.memo = np.full(MEMO, -1, np.int64), np.zeros(MEMO, dtype=bool)
        for n in range(2, self.longest + 1):
            some = size == n
            w, a, b = whole[some], left[some], right[some]
            ok = self.reached[a] & self.reached[b] & (self.rank[a] < self.rank[w]) & (self.rank[b] < self.rank[w])
            w, a, b = w[ok], a[ok], b[ok]
            ok = self._valid(a, b, self.rank[w])
            self.left[w[ok]], self.right[w[ok]], self.reached[w[ok]] = a[ok], b[ok], True
        self.reached &= np.isin(np.arange(len(self.text)), usable)

    def _valid(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border of a and b comes before `limit` or the merges that formed them."""
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), _FAR) if limit is None else limit.copy()
        while len(live):
            key = (a << 24) | b
            at = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
            early = (self.join_key[at] == key) & (self.join_rank[at] < limit)
            ok[live[early]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~early & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb, limit = live[go], a[go], b[go], ra[go], rb[go], limit[go]
            back_a = ra > rb  # equal pieces form from the left, so the right one is the later
            limit = np.where(back_a, ra, rb + 1)
            a, b = np.where(back_a, self.right[a], a), np.where(back_a, b, self.left[b])
        return ok

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_valid with a bounded memory of pairs seen before."""
        key = (a << 24) | b
        slot = (mixed(key.view(np.uint64)) & np.uint64(MEMO - 1)).astype(np.int64)
        known = self.memo_key[slot] == key
        out = self.memo[slot]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self._valid(a[new], b[new])
            self.memo_key[slot[new]], self.memo[slot[new]] = key[new], out[new]
            # of two pairs in one slot either may stay; keep key and value of the same one
            clash = self.memo_key[slot[new]] != key[new]
            if clash.any():
                self.memo_key[slot[new[clash]]] = -1
        return out

    def _search(self, chars: np.ndarray, known: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, ...]:
        """For words of one length (rows of code points): the piece that ends at each position, -1 for a character without
        one, its length, and the merit of the path to there.

        known holds these for the first `longest` positions and position 0 of rows that begin inside a word."""
        n, size = chars.shape
        most = min(self.longest, size)
        piece = np.full((most, n, size + 1), -1, dtype=np.int64)  # by length - 1 and end
        sums = np.zeros((n, size + 1), dtype=np.uint64)
        for j in range(size):
            sums[:, j + 1] = sums[:, j] * _BASE + chars[:, j].astype(np.uint64) + np.uint64(1)
        for k in range(1, most + 1):
            h = sums[:, k:] - sums[:, :-k] * self.powers[k]
            found = self._find(mixed((h + np.uint64(k)).ravel())).reshape(h.shape)
            if self.model == BPE and k > 1:
                found = np.where((found >= 0) & self.reached[found], found, -1)
            piece[k - 1, :, k:] = found
        last = np.full((n, size + 1), -1, dtype=np.int64)
        step = np.ones((n, size + 1), dtype=np.int64)
        merit = np.full((n, size + 1), -np.inf)
        merit[:, 0] = 0.0
        start = 0
        if known is not None:
            start = most
            last[:, : start + 1], step[:, : start + 1], merit[:, : start + 1] = known
        lens = np.arange(1, most + 1)
        for j in range(start + 1, size + 1):
            m = min(most, j)
            cand = piece[:m, :, j].T
            before = last[:, j - lens[:m]]
            usable = cand >= 0
            if self.model == BPE:
                # a lone character can always stand where no longer piece is valid; its own validity is checked alike
                first = (j - lens[:m] == 0)[None, :]
                pair = usable & ~first & (before >= 0)
                r, c = np.nonzero(pair)
                good = usable.copy()
                if len(r):
                    good[r, c] = self._follows(before[r, c], cand[r, c])
                value = np.where(good, lens[:m][None, :].astype(float), 0.0)
            else:
                back = merit[:, j - lens[:m]]
                value = np.where(usable, back + self.score[np.maximum(cand, 0)], -np.inf)
                value[:, 0] = np.where(usable[:, 0], value[:, 0], back[:, 0] + self.worst)
                value = value[:, ::-1]  # among equals the longest piece
            best = value.argmax(axis=1)
            if self.model != BPE:
                merit[:, j] = value[np.arange(n), best]
                best = m - 1 - best
            else:
                best = np.where(value[np.arange(n), best] > 0, best, 0)
            step[:, j] = best + 1
            last[:, j] = cand[np.arange(n), best]
        return last, step, merit

    def _long(self, word: str) -> bytes:
        """The ids of one word of more than LONG characters, whose search goes window by window.

        What ends at a position depends on the `longest` positions before it only.  For a BPE model windows are searched
        side by side from a run-up of their own; where a window's run-up ends with what the window before it found
        there, the rest agrees too, and otherwise that window is searched again from what is known."""
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        size, most = len(chars), self.longest
        last, step = np.full(size + 1, -1, np.int32), np.ones(size + 1, np.int8)

        def put(lo: int, found: tuple[np.ndarray, ...], row: int, frm: int) -> None:
            """Keeps positions from `frm` of a row that begins at lo."""
            last[lo + frm : lo + found[0].shape[1]], step[lo + frm : lo + found[0].shape[1]] = found[0][row, frm:], found[1][row, frm:]

        first = self._search(chars[None, :WINDOW])
        put(0, first, 0, 0)
        merit = first[2][0, -most - 1 :]  # of the path, which only a unigram model goes by
        lows = list(range(WINDOW, size, WINDOW))
        per = max(1, BATCH_CHARS // WINDOW) if self.model == BPE else 1
        for k in range(0, len(lows), per):
            some = lows[k : k + per]
            if self.model == BPE and (whole := [lo for lo in some if lo + WINDOW <= size]):
                found = self._search(np.stack([chars[lo - RUN_UP : lo + WINDOW] for lo in whole]))
            else:
                found, whole = None, []
            for i, lo in enumerate(some):
                back = slice(lo - most, lo + 1)
                if i < len(whole) and np.array_equal(found[0][i, RUN_UP - most : RUN_UP + 1], last[back]) and np.array_equal(found[1][i, RUN_UP - most : RUN_UP + 1], step[back]):
                    put(lo - RUN_UP, found, i, RUN_UP + 1)
                    continue
                again = self._search(chars[None, lo - most : lo + WINDOW], (last[None, back], step[None, back], merit[None, :]))
                put(lo - most, again, 0, most + 1)
                if self.model != BPE:
                    merit = again[2][0, -most - 1 :] - again[2][0, -1]
        ids, ends, at = [], [], size
        a, b = memoryview(last), memoryview(step)
        while at > 0:
            ids.append(a[at])
            ends.append(at)
            at -= b[at]
        ids, ends = np.array(ids[::-1], dtype=np.int32), np.array(ends[::-1])
        return self._filled(word, ids, ends) if (ids == -1).any() else ids.tobytes()

    def _learn(self, words: list[str]) -> None:
        """Segments words of one length and keeps their ids as bytes."""
        size = len(words[0])
        if size > LONG:
            self.long.update((w, self._long(w)) for w in words)
            return
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size)
        last, step, _ = self._search(chars)
        n = len(words)
        at = np.full(n, size)
        back = []
        rows = np.arange(n)
        while True:
            live = at > 0
            if not live.any():
                break
            back.append((np.where(live, last[rows, at], -2), at.copy()))
            at = np.where(live, at - step[rows, at], 0)
        ids = np.stack([b[0] for b in reversed(back)], axis=1)
        ends = np.stack([b[1] for b in reversed(back)], axis=1)
        inside = ids != -2
        flat, at_end = ids[inside], ends[inside]
        stop = np.cumsum(inside.sum(axis=1))
        lacking = (ids == -1).any(axis=1).tolist()
        whole = flat.astype(np.int32).tobytes()
        start = 0
        for w, end, lacks in zip(words, stop.tolist(), lacking):
            self.words[w] = self._filled(w, flat[start:end], at_end[start:end]) if lacks else whole[4 * start : 4 * end]
            start = end

    def _filled(self, word: str, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """ids with characters that no piece has as byte pieces, or runs of them as the unknown piece."""
        out: list[int] = []
        for t, e in zip(ids.tolist(), ends.tolist()):
            if t >= 0:
                out.append(t)
            elif self.bytes_at:
                out += [self.bytes_at[b] for b in word[e - 1].encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, dtype=np.int32).tobytes()

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = list(words)
        by_size: dict[int, list[str]] = {}
        for w in new:
            by_size.setdefault(len(w), []).append(w)
        for size, some in by_size.items():
            per = max(1, BATCH_CHARS // size)
            for k in range(0, len(some), per):
                self._learn(some[k : k + per])

    def _run(self, n: int) -> bytes:
        """Ids of n marks in a row.  The best-scored join comes first, the leftmost if tied; the longest run joins nothing."""
        top = max(self.run_ids)
        parts = [1] * (n % top)
        while True:
            joins = [(-self.score[self.run_ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.run_ids]
            if not joins:
                break
            k = min(joins)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        ids = [self.run_ids[top]] * (n // top) + [self.run_ids.get(p, self.unknown) for p in parts]
        return np.array(ids, dtype=np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without begin and end marks."""
        split = []
        for t in texts:
            parts = t.replace(META, " ").split(" ") if t else []  # a literal mark counts as a space
            if parts and not self.prefix:
                head, parts = parts[0], [META + p for p in parts[1:]]
                split.append([head, *parts] if head else parts)
            else:
                split.append([META + p for p in parts])
        self.long.clear()  # long words are kept for one call only
        self.learn(set().union(*map(set, split)) if split else set())
        words = ChainMap(self.words, self.long) if self.long else self.words
        one = np.array([self.one_mark if self.one_mark is not None else self.unknown], dtype=np.int32).tobytes()
        out = []
        for parts in split:
            if META not in parts:
                found = list(map(words.__getitem__, parts))
            else:
                found, marks = [], 0
                for p in parts:
                    if p == META:
                        marks += 1
                        continue
                    own = words[p]
                    if marks and own[:4] == one and p[0] == META:
                        found += [self._run(marks + 1), own[4:]]
                    else:
                        if marks:
                            found.append(self._run(marks))
                        found.append(own)
                    marks = 0
                if marks:
                    found.append(self._run(marks))
            out.append(np.frombuffer(b"".join(found), np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        if not len(ids):
            return ""
        size = self.raw_size[ids]
        at = np.repeat(self.raw_start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        text = self.raw[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def pieces_at(path: str) -> Pieces:
    return Pieces(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_ids, ids, round_trip (decoding the ids gives the text).

    `path` is a model file that every executor can open.  Null and empty texts have no ids.  A text that holds the
    space mark U+2581 itself encodes it as a space, as the library does, so its round trip is false.
    """
    staging.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_at(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = model.encode(texts)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            same = [model.decode(x) == t for x, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(same, pa.bool_())], ["id", "n_ids", "ids", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_ids long, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """rows with the text of each array of ids; a null array gives null."""

    @F.pandas_udf("string")
    def run(ids):
        return ids.map(lambda x: None if x is None else pieces_at(path).decode(np.asarray(x, dtype=np.int64)))

    return rows.withColumn(out, run(F.col(ids_col)))
