"""Text normalisation as column expressions; Unicode compatibility composition is the only UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGITS, DIGIT_LETTERS = "4310578269", "aeiostbzgg"
SYMBOLS, SYMBOL_LETTERS = "@$!|+", "asiit"
TOKEN_MAX = 24


@F.pandas_udf(T.StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC; only texts beyond ASCII reach Python."""
    beyond = F.when(~text.rlike(r"^[\x00-\x7F]*$"), text)
    return F.coalesce(_compose(beyond), text)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def mapped(lowered: Column) -> Column:
    """Look-alike digits (if the text has a letter or a look-alike symbol) and symbols become letters."""
    digits = F.when(lowered.rlike(r"[a-z@$!|+]"), F.translate(lowered, DIGITS, DIGIT_LETTERS)).otherwise(lowered)
    return F.translate(digits, SYMBOLS, SYMBOL_LETTERS)


def normalized(text: Column) -> Column:
    """Letters and digits between single spaces, of a text in NFKC."""
    return F.trim(F.regexp_replace(mapped(F.lower(text)), "[^a-z0-9]+", " "))


def compact(text: Column) -> Column:
    """normalized() without spaces."""
    return F.regexp_replace(mapped(F.lower(text)), "[^a-z0-9]+", "")


def collapsed(word: Column) -> Column:
    """Runs of one character become one, also where a space stood between."""
    return F.regexp_replace(word, r"(.)\1+", "$1")


def chunks(text: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda c: c != "")


def canonical(word: Column) -> Column:
    """Runs of at most two, and a final `ie` of a longer word as `y`."""
    two = F.regexp_replace(word, r"(.)\1{2,}", "$1$1")
    return F.when(F.length(two) >= 5, F.regexp_replace(two, "ie$", "y")).otherwise(two)


def consonants(word: Column) -> Column:
    rest = F.regexp_replace(word, "[aeiou]", "")
    return F.when(F.length(rest) >= 2, rest).otherwise(word)


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))


def lexicon_word(text: Column) -> Column:
    """Letters of a word of 3 to 24, else null."""
    w = F.regexp_replace(ascii_lower(F.trim(text)), "[^a-z]", "")
    return F.when(F.length(w).between(3, TOKEN_MAX), w)


def seed_word(text: Column) -> Column:
    w = F.lower(F.trim(text))
    return F.when(w.rlike(f"^[a-z]{{4,{TOKEN_MAX}}}$"), w)


def context_phrase(text: Column) -> Column:
    """Tokens joined by a space if there are 2 to 24 of them, else null."""
    t = ascii_tokens(text)
    return F.when(F.size(t).between(2, TOKEN_MAX), F.array_join(t, " "))


def clean_context(text: Column) -> Column:
    """Lower case without addresses and rare signs, between single spaces."""
    t = F.regexp_replace(F.lower(text), r"https?://\S+|www\.\S+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s.,!?'-]", " "), r"\s+", " "))


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def term(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}]", "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def dictionary_word(text: Column) -> Column:
    w = F.lower(F.trim(F.replace(text, F.lit("*"), F.lit(""))))
    return F.when(F.length(w) >= 2, w)


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def first_letter_mask(word: Column) -> Column:
    return F.concat(F.left(word, F.lit(1)), F.repeat(F.lit("•"), 8))


def date_int(day: Column) -> Column:
    """A date as the number yyyymmdd."""
    return F.date_format(day, "yyyyMMdd").cast("int")


def first_sentence_length(text: Column) -> Column:
    """Characters of the first sentence, up to its . ; ! or ? and without leading spaces; of the whole text if it has none."""
    return F.length(F.regexp_extract(text, r"^ *([^.;!?]*)", 1))


def question_count(text: Column) -> Column:
    """Sentences that end in a question mark and have more than one character."""
    return F.regexp_count(text, F.lit(r"[^.!;?]{2,}\?"))
