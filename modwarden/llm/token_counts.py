"""Token counts by rank-synchronous merging of byte-level BPE over ragged numpy arrays.

The pre-tokens of a batch lie end to end in one array of symbols.  In every round each pre-token finds the
lowest rank among its adjacent pairs and merges all places of that pair at once; pre-tokens without a ranked
pair leave the array with their count of surviving symbols.  As a merge only makes pairs of higher rank, this
gives what merging one place at a time gives.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modwarden.llm import common

#: The public pre-token pattern of byte-level BPE.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between two characters that neither library calls white space always begins a pre-token.
_ODD_SPACE = re.compile(r"[\s\x1c-\x1f] | [\s\x1c-\x1f]")
_SAFE_SPACE = re.compile(r"(?<![\s\x1c-\x1f]) (?![\s\x1c-\x1f])")
_FAR = np.int64(1) << 40
#: Bounds that keep memory level; they change no result.
CACHE_WORDS = 100_000
CHUNK_PIECES = 50_000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stays, the rest follow from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RankedMerges:
    """The merges of a byte-level BPE file and the batch counter over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.specials = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.base = np.array([vocab[c] for _, c in sorted(byte_alphabet().items())], dtype=np.int64)
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], dtype=np.int64)
        new = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.new = keys[order], order.astype(np.int64), new[order]
        self.of_bytes, _ = self._look(np.repeat(self.base, 256), np.tile(self.base, 256))

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _FAR), np.where(hit, self.new[at], -1)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word."""
        out = np.zeros(len(words), dtype=np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        who = np.flatnonzero(size > 0)
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        sym, size = self.base[raw], size[who]
        last = np.cumsum(size) - 1
        rank = np.full(len(sym), _FAR)
        rank[:-1] = self.of_bytes[raw[:-1] * 256 + raw[1:]]
        rank[last] = _FAR  # no pair leaves its word
        while len(who):
            start = last - size + 1
            low = np.minimum.reduceat(rank, start)
            live = low < _FAR
            if not live.all():
                out[who[~live]] = size[~live]
                keep = np.repeat(live, size)
                sym, rank, who, size, low = sym[keep], rank[keep], who[live], size[live], low[live]
                if not len(who):
                    break
                last = np.cumsum(size) - 1
            hit = rank == np.repeat(low, size)
            at = np.flatnonzero(hit)
            # in a run of one repeated symbol every second pair merges, from the left
            run = np.flatnonzero(np.r_[True, np.diff(at) > 1])
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[place % 2 == 0]
            _, merged = self._look(sym[at], sym[at + 1])
            sym[at] = merged
            rank[at] = rank[at + 1]  # a word's end stays its end
            gone = np.zeros(len(sym), dtype=bool)
            gone[at + 1] = True
            size = size - np.add.reduceat(gone.astype(np.int64), np.r_[0, last[:-1] + 1])
            new_at = at - np.arange(len(at))
            sym, rank = sym[~gone], rank[~gone]
            last = np.cumsum(size) - 1
            ends = np.zeros(len(sym), dtype=bool)
            ends[last] = True
            touched = np.r_[new_at, new_at[new_at > 0] - 1]
            touched = touched[~ends[touched]]
            rank[touched] = self._look(sym[touched], sym[touched + 1])[0]
        return out


@lru_cache(maxsize=4)
def merges_at(path: str) -> RankedMerges:
    return RankedMerges(path)


class Counter:
    """Counts tokens of texts; remembers counts of pieces and pre-tokens up to CACHE_WORDS each."""

    def __init__(self, path: str):
        self.bpe = merges_at(path)
        self.pattern = regex.compile(PRETOKEN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.bpe.specials, key=len, reverse=True)))) if self.bpe.specials else None
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.pieces]
        if not new:
            return
        if len(self.pieces) + len(new) > CACHE_WORDS:
            self.pieces.clear()
            new = list(pieces)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        split = [self.pattern.findall(p) for p in new]
        unseen = list({w for ws in split for w in ws if w not in self.words})
        if unseen:
            self.words.update(zip(unseen, self.bpe.counts([w.encode("utf-8", "surrogatepass") for w in unseen]).tolist()))
        get = self.words.__getitem__
        self.pieces.update((p, sum(map(get, ws))) for p, ws in zip(new, split))

    def _parts(self, text: str) -> list[str]:
        if not text:
            return []
        if _ODD_SPACE.search(text) is None and text[0] != " " and text[-1] != " ":
            parts = text.split(" ")
        else:
            parts = _SAFE_SPACE.split(text)
        return [parts[0], *[" " + p for p in parts[1:]]]

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        waiting: list[tuple[int, list[str]]] = []
        held = 0
        for i, text in enumerate(texts):
            bodies = [text]
            if self.special is not None:
                bodies = self.special.split(text)
                out[i] += len(bodies) - 1
            for body in bodies:
                parts = self._parts(body)
                for k in range(0, len(parts), CHUNK_PIECES):
                    waiting.append((i, parts[k : k + CHUNK_PIECES]))
                    held += len(waiting[-1][1])
                    if held >= CHUNK_PIECES:
                        self._settle(waiting, out)
                        waiting, held = [], 0
        self._settle(waiting, out)
        return out

    def _settle(self, waiting: list[tuple[int, list[str]]], out: list[int]) -> None:
        self._learn(set().union(*[p for _, p in waiting]) if waiting else set())
        get = self.pieces.__getitem__
        for i, parts in waiting:
            out[i] += sum(map(get, parts))


def n_tokens(text: Column, path: str) -> Column:
    """Tokens of a text by the byte-level BPE file at `path`, which every executor must be able to open.

    Null and empty texts have 0.  Special strings of the file inside a text count as one token each, as the
    library does by default.  What a task remembers goes at its end, as an executor keeps more workers than it runs.
    """

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path)
        for texts in batches:
            yield pd.Series(counter.count(texts.fillna("").tolist()), dtype="int64")
        del counter
        common.release()

    return count(text)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit); columns of these names are replaced."""
    return (
        docs.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long"))
        .withColumn("n_tokens", n_tokens(F.col(text_col), path))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
