"""Suffix arrays by induced sorting and permuted common prefixes, in numpy.

Inducing is sequential only from bucket to bucket and from one round of equal first symbols to the next, so each
round of a bucket is a handful of array operations.  The reduced string of leftmost-smaller (LMS) substrings is
sorted by doubling the ranks of those of its suffixes that are still tied.
"""

from __future__ import annotations

import numpy as np

from modwarden.llm.shingles import powers


def s_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol must be the only smallest."""
    n = len(s)
    smaller = np.empty(n, dtype=bool)
    smaller[-1] = True
    step = np.diff(s.astype(np.int32))
    # an equal neighbour passes on the type of the next change
    change = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(change[::-1])[::-1]
    smaller[:-1] = step[np.minimum(nxt, n - 2)] > 0
    return smaller


def _deal(sa: np.ndarray, s: np.ndarray, found: np.ndarray, at: np.ndarray, sign: int) -> None:
    """Puts found, in order, at the fronts (sign 1) or backs (sign -1) of their buckets and moves those on."""
    first = s[found]
    order = np.argsort(first, kind="stable")
    first, found = first[order], found[order]
    start = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
    size = np.diff(np.concatenate((start, [len(first)])))
    place = np.arange(len(first)) - np.repeat(start, size)
    sa[at[first] + sign * place] = found
    at[first[start]] += sign * size


def induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes in order, given the LMS suffixes in order (or, for naming, in any order)."""
    n = len(s)
    total = np.bincount(s, minlength=alphabet)
    ends = np.cumsum(total)
    heads = ends - total
    larger_n = np.bincount(s[~smaller], minlength=alphabet)
    sa = np.full(n, -1, dtype=np.int64)
    back = ends - 1
    _deal(sa, s, lms[::-1], back, -1)
    lms_from = back + 1
    front = heads.copy()
    symbols = np.flatnonzero(total)
    for c in symbols:
        done = heads[c]
        while done < front[c]:
            block = sa[done : front[c]]
            done = front[c]
            prev = block[block > 0] - 1
            prev = prev[~smaller[prev]]
            if len(prev):
                _deal(sa, s, prev, front, 1)
        block = sa[lms_from[c] : ends[c]]
        prev = block[block > 0] - 1
        prev = prev[~smaller[prev]]
        if len(prev):
            _deal(sa, s, prev, front, 1)
    back = ends - 1
    for c in symbols[::-1]:
        done = ends[c] - 1
        while done > back[c]:
            block = sa[back[c] + 1 : done + 1][::-1]
            done = back[c]
            prev = block[block > 0] - 1
            prev = prev[smaller[prev]]
            if len(prev):
                _deal(sa, s, prev, back, -1)
        block = sa[heads[c] : heads[c] + larger_n[c]][::-1]
        prev = block[block > 0] - 1
        prev = prev[smaller[prev]]
        if len(prev):
            _deal(sa, s, prev, back, -1)
    sa[0] = n - 1  # the end mark comes first; nothing induces it
    return sa


def _sorted_ranks(names: np.ndarray) -> np.ndarray:
    """The suffixes of the reduced string in order: ranks of tied suffixes are doubled in length until none are tied."""
    m = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(m + 1, dtype=np.int64)
    rank[m] = -1
    new = np.concatenate(([True], names[order][1:] != names[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    reach = 1
    while True:
        r = rank[order]
        same = np.concatenate((r[1:] == r[:-1], [False]))
        tied = same | np.concatenate(([False], same[:-1]))
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        some = order[at]
        head = rank[some]
        tail = rank[np.minimum(some + reach, m)]
        by = np.lexsort((tail, head))
        some, head, tail = some[by], head[by], tail[by]
        order[at] = some
        new = np.concatenate(([True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])))
        rank[some] = np.maximum.accumulate(np.where(new, at, 0))
        reach *= 2


def suffix_array(s: np.ndarray, alphabet: int) -> np.ndarray:
    """Positions of the suffixes of s in order; s ends with its only smallest symbol."""
    n = len(s)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    smaller = s_types(s)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) > 1:
        rough = induce(s, smaller, lms, alphabet)
        by_substring = rough[is_lms[rough]]
        # equal substrings get one name; they are compared by length and a 64-bit polynomial of symbols and types
        up, down = powers(n + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((s.astype(np.uint64) * np.uint64(2) + smaller + np.uint64(1)) * up[:n])))
        end = np.full(n, n, dtype=np.int64)
        end[lms[:-1]] = lms[1:] + 1
        last = end[by_substring]
        content = (sums[last] - sums[by_substring]) * down[by_substring]
        size = last - by_substring
        new = np.concatenate(([True], (content[1:] != content[:-1]) | (size[1:] != size[:-1])))
        name_at = np.empty(n, dtype=np.int64)
        name_at[by_substring] = np.cumsum(new) - 1
        names = name_at[lms]
        lms = by_substring if new.all() else lms[_sorted_ranks(names)]
    return induce(s, smaller, lms, alphabet)


def permuted_lcp(s: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(lcp, before): by position, the common prefix with the suffix before it in order, up to about `most`, and that suffix.

    Only positions whose left neighbours differ from those of the suffix before are compared symbol by symbol;
    at every other position the prefix is one shorter than at the position to its left.
    """
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    pos = np.arange(n)
    left = np.zeros(n, dtype=bool)
    ok = (pos > 0) & (before > 0)
    left[ok] = s[pos[ok] - 1] == s[before[ok] - 1]
    own = np.flatnonzero(~left & (before >= 0))
    lcp = np.zeros(n, dtype=np.int64)
    live, k = own, 0
    limit = n - np.maximum(own, before[own])
    length = np.zeros(len(own), dtype=np.int64)
    idx = np.arange(len(own))
    while len(live):
        # one symbol at a time at first, when most pairs part, then longer strides
        inside = k < limit[idx]
        live, idx = live[inside], idx[inside]
        same = s[live + k] == s[before[live] + k]
        live, idx = live[same], idx[same]
        k += 1
        length[idx] = k
        if k >= most + n:
            break
    lcp[own] = length
    anchor = np.maximum.accumulate(np.where(left, 0, pos))
    lcp = np.where(left, np.maximum(lcp[anchor] - (pos - anchor), 0), lcp)
    return lcp, before
