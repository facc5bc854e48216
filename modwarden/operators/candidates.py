"""Candidate extraction: which words of a message are looked up in lexicons.

A message gives two streams, of compact and of collapsed words.  A stream has the words of its white-space pieces,
canonical variants of obfuscated ones, and runs of short neighbouring pieces merged; its first 128 distinct texts
count.  The streams then join to one list of at most 128.

This is an Arrow-batched UDF: a stream ends at its 128th text, which a loop can stop at, while array expressions
would build every candidate of a long text first (and copy the array for every slice).  Pieces are looked at one by one,
so of a long text little more than those 128 is.  Nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modwarden.functions import text as X

MOST, LONGEST, SHORT, JOINED = 128, 24, 3, 5
_DIGITS, _SYMBOLS = str.maketrans(X.DIGITS, X.DIGIT_LETTERS), str.maketrans(X.SYMBOLS, X.SYMBOL_LETTERS)
_LOOKALIKE, _OTHER, _NOT_ALPHA = re.compile(r"[a-z@$!|+]"), re.compile(r"[^a-z0-9]+"), re.compile(r"[^A-Za-z]")
_RUN, _TRIPLE, _AGAIN, _THRICE = re.compile(r"([zxqvjk])\1|(.)\2\2", re.S), re.compile(r"(.)\1{2,}"), re.compile(r"(.)\1+"), r"\1\1"
#: A piece between Unicode white space, which leaves out the four separators U+001C to U+001F.
_PIECE = re.compile(r"[\S\x1c-\x1f]+")
_VOWELS = frozenset("aeiou")

#: A candidate with its flag of obfuscation in each list that holds it; null where a list does not.
CANDIDATES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *[T.StructField(n, T.BooleanType()) for n in ("strict", "collapsed", "merged")]]))
_RESULT = T.StructType([T.StructField("composed", T.StringType()), T.StructField("candidates", CANDIDATES)])


def heavy(word: str) -> bool:
    """Too few vowels for its length."""
    vowels = sum(c in _VOWELS for c in word)
    return len(word) >= 3 and (vowels == 0 if len(word) <= 4 else vowels / len(word) <= 0.22)


def variant(word: str) -> str:
    two = _TRIPLE.sub(_THRICE, word)
    return two[:-2] + "y" if len(two) >= 5 and two.endswith("ie") else two


@lru_cache(maxsize=100_000)
def looked_at(raw: str) -> tuple[tuple[str, bool], tuple[str, bool]]:
    """(compact word, obfuscated) and (collapsed word, obfuscated) of a piece."""
    low = raw.lower()
    word = _OTHER.sub("", (low.translate(_DIGITS) if _LOOKALIKE.search(low) else low).translate(_SYMBOLS))
    odd = _NOT_ALPHA.search(raw) is not None or _RUN.search(low) is not None
    single = _AGAIN.sub(r"\1", word)
    return (word, odd or heavy(word)), (single, odd or heavy(single))


def stream(text: str, side: int) -> dict[str, bool]:
    """The first MOST distinct texts of a stream (0 compact, 1 collapsed) with the flag each came with first."""
    out: dict[str, bool] = {}
    found: list[tuple[str, bool]] = []
    for m in _PIECE.finditer(text):
        word, odd = piece = looked_at(m[0])[side]
        if not 1 <= len(word) <= LONGEST:
            continue
        found.append(piece)
        if len(word) >= 2:
            out.setdefault(word, odd)
        if odd and len(out) < MOST:
            other = variant(word)
            if other != word:
                out.setdefault(other, True)
        if len(out) >= MOST:
            return out
    for i, (word, odd) in enumerate(found):
        if len(word) > SHORT:
            continue
        singles = len(word) == 1
        for nxt, nxt_odd in found[i + 1 : i + JOINED]:
            if len(nxt) > SHORT:
                break
            word, odd, singles = word + nxt, odd or nxt_odd, singles + (len(nxt) == 1)
            if len(word) >= 3 and (odd or singles >= 2):
                out.setdefault(word, True)
                if len(out) >= MOST:
                    return out
    return out


def joined(strict: dict[str, bool], collapsed: dict[str, bool]) -> dict[str, bool]:
    """Both streams as one: the first place of a text counts, flags are or-ed, and all ends at the 129th text."""
    out = dict(strict)
    for word, odd in collapsed.items():
        if word in out:
            out[word] = out[word] or odd
        elif len(out) >= MOST:
            break
        else:
            out[word] = odd
    return out


def extracted(text: str | None) -> tuple[dict[str, bool], dict[str, bool], dict[str, bool]]:
    """strict, collapsed and merged candidates of a composed (NFKC) message; a null message has none."""
    strict, collapsed = stream(text or "", 0), stream(text or "", 1)
    return strict, collapsed, joined(strict, collapsed)


def _extract(texts: pa.Array) -> pa.Array:
    composed, ends = [], [0]
    word, flags = [], ([], [], [])
    for text in texts.to_pylist():
        whole = text if text is None or text.isascii() else unicodedata.normalize("NFKC", text)
        composed.append(None if whole == text else whole)
        lists = extracted(whole)
        some = lists[0] | lists[1]  # in this order the merged list is a prefix
        word += some
        for own, flag in zip(lists, flags):
            flag += map(own.get, some)
        ends.append(len(word))
    items = pa.StructArray.from_arrays([pa.array(word, pa.string()), *[pa.array(f, pa.bool_()) for f in flags]], ["text", "strict", "collapsed", "merged"])
    return pa.StructArray.from_arrays([pa.array(composed, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], ["composed", "candidates"])


# not deterministic to the optimizer, which would else evaluate it once for a filter on the array and once for its rows
_extracted = F.arrow_udf(_extract, _RESULT).asNondeterministic()


def with_candidates(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """messages with composed, the text in NFKC, and candidates: see CANDIDATES.  The place of a candidate in the array is
    its place in the strict and in the merged list."""
    rows = messages.withColumn("__c", _extracted(F.col(text_col)))
    return rows.select(*messages.columns, F.coalesce("__c.composed", text_col).alias("composed"), "__c.candidates")
