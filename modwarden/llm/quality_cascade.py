"""Quality rules as a short-circuit cascade ordered by rejections per cost.

A rule looks at features of one text; features are computed when first asked for and kept for later rules.  On a
sample every rule runs on every text: its seconds and its rejections give an estimate, and the cascade runs the
rules with most rejections per second first, so most rejected texts never pay for the dear rules.  The order
changes the cost only: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modwarden import staging

#: Rows whose texts estimate cost and selectivity, and partitions whose first rows they are: a bounded sample,
#: whatever the table's size, for which the rest of the text is not read.
SAMPLE_ROWS, SAMPLE_PARTS = 400, 32

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


class Features:
    """Features of one text, each computed once, when asked for.  A null text has no words and one empty line."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name: str):
        value = getattr(type(self), f"_{name}")(self)
        self.__dict__[name] = value
        return value

    def _words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACES))

    def _n_symbols(self) -> int:
        return sum(map(self.text.count, _SYMBOLS))

    def _lines(self) -> list[str]:
        """Lines that have a word."""
        return [x for x in self.text.split("\n") if x.strip(_SPACES)]

    def _n_lines(self) -> int:
        return len(self.lines)

    def _n_dup_lines(self) -> int:
        return self.n_lines - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        """Words inside three-word windows that the text holds at least twice."""
        w = self.words
        seen = Counter(zip(w, w[1:], w[2:]))
        if len(seen) == max(0, len(w) - 2):
            return 0
        total, reach = 0, 0
        for i, window in enumerate(zip(w, w[1:], w[2:])):
            if seen[window] > 1:
                total += i + 3 - max(i, reach)
                reach = i + 3
        return total

    def _n_lettered(self) -> int:
        return sum(1 for w in self.words if _LETTER.search(w))

    def _n_upper(self) -> int:
        return len(re.findall("[A-Z]", self.text))

    def _n_lower(self) -> int:
        return len(re.findall("[a-z]", self.text))

    def _n_beyond(self) -> int:
        """Characters beyond ASCII."""
        return 0 if self.text.isascii() else len(self.text) - len(self.text.encode("ascii", "ignore"))

    def _n_exclaim(self) -> int:
        return self.text.count("!")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


#: The contract's base: too few words, or half of them in repeated windows.
BASE = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)
#: The rules beyond the base.
RULES = (
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 15 * f.n_words),
    Rule("symbols", lambda f: 100 * f.n_symbols > 10 * f.n_words),
    Rule("duplicate_lines", lambda f: 100 * f.n_dup_lines > 30 * f.n_lines),
    Rule("letters", lambda f: 100 * f.n_lettered < 70 * f.n_words),
    # A-Z must outnumber all that may be small letters: a text of another script does not go by an acronym
    Rule("shouting", lambda f: f.n_upper > f.n_lower and f.n_upper > f.n_lower + f.n_beyond),
    Rule("exclamations", lambda f: 100 * f.n_exclaim > 30 * f.n_words),
)


def estimates(docs: DataFrame, text_col: str, rules: tuple[Rule, ...]) -> list[tuple[str, float, float]]:
    """(rule, seconds, rejections) of each rule on the sample, summed on the executors: one row a rule comes back."""
    staging.small_batches(docs.sparkSession)
    sample = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = max(1, sample._jdf.rdd().getNumPartitions())
    chosen = {i * parts // min(parts, SAMPLE_PARTS) for i in range(min(parts, SAMPLE_PARTS))}
    each = -(-SAMPLE_ROWS // len(chosen))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = each if TaskContext.get().partitionId() in chosen else 0
        while wanted > 0 and (frame := next(frames, None)) is not None:
            rows = []
            texts = frame["text"].iloc[:wanted]
            wanted -= len(texts)
            for text in texts:
                for r in rules:
                    own, began = Features(text), time.perf_counter()
                    bad = r.rejects(own)
                    rows.append((r.name, time.perf_counter() - began, float(bad)))
            yield pd.DataFrame(rows, columns=["rule", "seconds", "rejected"]).groupby("rule", as_index=False).sum()

    found = sample.mapInPandas(run, "rule string, seconds double, rejected double").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r")).collect()
    by = {x["rule"]: (x["s"], x["r"]) for x in found}
    return [(r.name, *by.get(r.name, (0.0, 0.0))) for r in rules]


def ordered(rules: tuple[Rule, ...], measured: list[tuple[str, float, float]]) -> tuple[Rule, ...]:
    """Most rejections per second first; rules that rejected nothing go by cost, cheapest first."""
    by = {name: (-(rejected / seconds) if seconds > 0 else 0.0, seconds, name) for name, seconds, rejected in measured}
    return tuple(sorted(rules, key=lambda r: by[r.name]))


def passes(rules: tuple[Rule, ...], f: Features) -> bool:
    return not any(r.rejects(f) for r in rules)


def kept(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE + RULES) -> DataFrame:
    """The rows of docs, all columns as they were, that no rule rejects.  Null and empty texts have no words and go."""
    order = ordered(rules, estimates(docs, text_col, rules))

    @F.pandas_udf(T.BooleanType())
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series([passes(order, Features(t)) for t in texts], dtype=bool)

    return docs.where(good(F.col(f"`{text_col}`")))


_REPORT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the base features, whether the base rules fail it, and whether the whole cascade keeps it.

    A null or empty text has no words, so base_failed holds and kept does not.  Each row is judged by itself: repeated
    rows and null ids have a row each.  An empty table gives an empty result; other columns are left out.
    """
    order = ordered(RULES, estimates(docs, text_col, RULES))
    names = [x.split()[0] for x in _REPORT.split(", ")]

    @F.pandas_udf(T.StructType([T.StructField(x.split()[0], T.LongType() if x.endswith("long") else T.BooleanType()) for x in _REPORT.split(", ")]))
    def look(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            f = Features(t)
            failed = not passes(BASE, f)
            rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, not failed and passes(order, f)))
        return pd.DataFrame(rows, columns=names)

    return docs.select(id_col, look(F.col(text_col)).alias("__f")).select(id_col, "__f.*")
