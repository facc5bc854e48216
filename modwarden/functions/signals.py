"""Predicates over a message as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from modwarden import lexicon
from modwarden.functions import text as X


def surface(composed: Column, raw: Column | None = None) -> dict[str, Column]:
    """digit, leet, hard_separator, hyphen_only, apostrophe and alpha_only of a message; raw is it before NFKC."""
    raw = composed if raw is None else raw
    digit, leet = composed.rlike("[0-9]"), composed.rlike(r"[@$!|+]")
    hard = composed.rlike(r"[#@$_]") | raw.rlike("[​‌‍﻿]") | (composed.rlike(r"[./\\]") & composed.rlike("[A-Za-z]"))
    return {
        "digit": digit,
        "leet": leet,
        "hard_separator": hard,
        "hyphen_only": composed.contains("-") & ~digit & ~leet & ~hard,
        "apostrophe": composed.rlike("['’]"),
        "alpha_only": composed.rlike(r"^[A-Za-z]+\z"),
    }


def _any_token(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


def high_risk_phrase(text: Column) -> Column:
    """Whether a phrase stands in the text between literal spaces."""
    padded = F.concat(F.lit(" "), X.ascii_lower(text), F.lit(" "))
    return padded.rlike(f" (?:{'|'.join(lexicon.HIGH_RISK_PHRASES)}) ")


def trigger(text: Column) -> Column:
    return _any_token(X.ascii_tokens(text), lexicon.TRIGGER_TOKENS) | high_risk_phrase(text)


def link(text: Column) -> Column:
    marks = "|".join(re.escape(m) for m in lexicon.LINK_MARKS)
    return X.ascii_lower(text).rlike(f"@[a-z0-9_]{{4,}}|{marks}")


def money(text: Column) -> Column:
    return text.rlike("[$€£₽₴]") | _any_token(X.ascii_tokens(text), lexicon.MONEY_TOKENS)


def urgency(text: Column) -> Column:
    return _any_token(X.ascii_tokens(text), lexicon.URGENCY_TOKENS)


def date_like(text: Column) -> Column:
    return text.rlike(r"^[0-9]{1,4}([./-][0-9]{1,4}){1,3}\z")


def numeric_noise(text: Column) -> Column:
    digits, letters = F.length(F.regexp_replace(text, "[^0-9]", "")), F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return ((digits >= 3) & (letters == 0)) | ((digits >= 4) & (digits >= 2 * letters))


def code_like(text: Column) -> Column:
    return (F.octet_length(text) >= 4) & text.rlike("[0-9]") & text.rlike("[._:/-]") & text.rlike(r"^[A-Za-z0-9._:/-]+\z")


def math_like(text: Column) -> Column:
    low = X.ascii_lower(text)
    return low.rlike(r"(?<![a-z])(sin|cos|tan|cot|sec|csc|log|ln|sqrt)(?![a-z])") | (text.rlike(r"^[0-9+*/^().,=\s-]+\z") & text.rlike(r"[+*/^=-]"))


def fallback_gate(text: Column, s: dict[str, Column]) -> Column:
    """Whether an unresolved message is worth a vector search."""
    n = F.size(X.chunks(text))
    wordy = (F.octet_length(text) >= 16) & (n >= 3) & ~s["leet"] & ~s["hard_separator"]
    return trigger(text) | (wordy & (link(text) | money(text) | urgency(text) | (n >= 5)))


def label_state(label: Column) -> Column:
    """True, False or null for a label in words or digits; negatives are looked for first."""
    low = F.lower(F.trim(label))
    return (
        F.when(low.rlike("|".join(lexicon.CLEAN_LABELS)), F.lit(False))
        .when(low.rlike("|".join(lexicon.TOXIC_LABELS)), F.lit(True))
        .when(low == "0", F.lit(False))
        .when(low == "1", F.lit(True))
    )
