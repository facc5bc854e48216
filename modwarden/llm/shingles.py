"""Word shingles of whole batches of texts as 64-bit hashes, by numpy over one byte buffer.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lowered.  A word's hash is a polynomial over its bytes
modulo 2^64, read off prefix sums and then mixed; a shingle's hash mixes the hashes of its words in order.
Sets are compared by these hashes; two different shingles meet with a chance of about 2^-64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, np.uint64(_BASE), dtype=np.uint64)
    down = np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)), dtype=np.uint64)
    up[0] = down[0] = np.uint64(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def word_hashes(text: bytes) -> np.ndarray:
    """The hash of each word of one lowered text."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    gap = _GAP[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1])))
    h = (sums[end] - sums[start]) * down[start]
    return mixed(h + (end - start).astype(np.uint64) * _MULT)


def _unspaced(raw: np.ndarray) -> np.ndarray:
    """Where a character of three bytes starts whose script puts no spaces between words: Thai, Lao, Burmese, Khmer,
    kana and Han up to U+9FFF."""
    nxt = np.concatenate((raw[1:], [0]))
    return ((raw >= 0xE3) & (raw <= 0xE9)) | ((raw == 0xE0) & (nxt >= 0xB8) & (nxt <= 0xBB)) | ((raw == 0xE1) & (((nxt >= 0x80) & (nxt <= 0x82)) | (nxt == 0x9E) | (nxt == 0x9F)))


def word_places(text: bytes | np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, hash) of each word of one text, or of texts that stand one after another and start and end at
    bounds.  A character of a script without spaces is a word of its own."""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64)
    gap = _GAP[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[[0, n]] = True
    edge[1:n] = gap[1:] != gap[:-1]
    if raw.max() >= 0xE0:
        single = np.flatnonzero(_unspaced(raw))
        edge[single] = True
        edge[np.minimum(single + 3, n)] = True
    if bounds is not None:
        edge[bounds] = True
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    start, end = start[~gap[start]], end[~gap[start]]
    up, down = powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1])))
    return start, end, mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _MULT)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `width` words; with fewer words, of the whole sequence; without words, none."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return words
    n = min(width, len(words))
    h = np.full(len(words) - n + 1, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        h = mixed(h * _MULT + words[k : len(words) - n + 1 + k])
    return np.unique(h)
