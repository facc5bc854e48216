"""Project-owned word lists, and lexicons: what the cascade looks words up in, of these lists or of scanned tables.

The project's lists are small and fixed, so their tables may always be broadcast.  A lexicon of scanned tables is counted:
up to BROADCAST_WORDS words it is broadcast, beyond that the joins shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modwarden.functions import text as X

# Word lists and weights that results depend on.
TRIGGER_TOKENS = "die kill suicide yourself end rope jump wallet crypto airdrop seed scam fraud phishing btc eth usdt card cvv otp pin".split()
MONEY_TOKENS = "usd eur btc eth ton trx usdt wallet card cvv otp pin".split()
URGENCY_TOKENS = "urgent immediately now verify confirm claim winner bonus profit investment security".split()
HIGH_RISK_PHRASES = ["kill yourself", "end yourself", "go die", "just die", "die now", "commit suicide", "hang yourself", "jump off", "gas yourself", "off yourself"]
LINK_MARKS = ["http://", "https://", "t.me/", "bit.ly/", "tinyurl.com/", "wa.me/"]
SHORT_TAGS = ["acronym", "acronyms", "short-acronym", "abbreviation", "abbreviations"]
CLEAN_LABELS = ["neither", "not hate", "not_hate", "non-toxic", "clean"]
TOXIC_LABELS = ["hate", "offensive", "toxic", "abusive", "insult"]
AGGRESSIVE_TAGS = ["aggressive", "severe", "racism", "hate"]
WEIGHTS = {
    "bias": -1.977544,
    "native_exact": 6.527671,
    "exact": 5.90314,
    "fuzzy_strong": 2.624151,
    "fuzzy_weak": 0.926993,
    "skeleton": -0.254495,
    "obfuscated": -0.378307,
    "hard_separator": 2.934235,
    "leet": 0.091841,
    "digit": 1.4017,
    "hyphen_only": -1.034374,
    "apostrophe": -1.432345,
    "alpha_only": -2.070695,
    "likely_clean": -1.359141,
    "short_token": -0.322736,
    "long_token": 0.291107,
}
REVIEW_THRESHOLD, BLOCK_THRESHOLD = 0.15, 0.25

#: word, severity, tags, category; words of severity 1 are dropped by the lexicon build.
BAD_ENTRIES = [
    ("trash", 3, ["insult"], "insult"),
    ("clown", 2, ["insult"], "insult"),
    ("idiot", 3, ["insult"], "insult"),
    ("scum", 3, ["insult"], "insult"),
    ("worthless", 3, ["insult"], "insult"),
    ("moron", 3, ["insult"], "insult"),
    ("pathetic", 2, ["insult"], "insult"),
    ("loser", 2, ["insult"], "insult"),
    ("disgusting", 3, ["insult"], "insult"),
    ("stupid", 3, ["insult"], "insult"),
    ("silly", 1, ["mild"], "insult"),
    ("hth", 3, ["acronym"], "acronym"),
    ("whh", 4, ["acronym", "aggressive"], "acronym"),
]
WHITELIST = ["clown", "closer", "moron", "the", "that", "with"]
CLEAN_WORDS = ["this", "from", "have", "were", "which", "und", "die", "der", "das", "para", "como", "dans", "pour", "avec", "these", "those", "what", "there", "loses", "idiom", "than", "then", "hath", "tion", "thin"]
PHRASES = ["just die", "end of this", "der die das", "from this card", "kill the process", "these were the"]
#: Invented examples of one kind of scam.
SCAM_EXAMPLES = [
    "free nitro for the first hundred members, claim it now",
    "claim your gift of three months before midnight",
    "your account won a bonus, confirm it under this link",
    "send one coin and get two back today",
    "verify the wallet seed to keep your access",
    "the airdrop ends in ten minutes, connect now",
    "staff will ban you unless you confirm your card",
    "cheap boosts, pay first and trust me",
    "vote for my team here, it needs your login",
]
SLANG = {"lmk": "let me know", "smh": "shaking my head", "dumbo": "foolish person", "nitwit": "silly person"}

BAD_WORDS = sorted({w for w, s, _, _ in BAD_ENTRIES if s >= 2 and len(w) >= 4} | {k for k in SLANG if len(k) >= 4})
SHORT_WORDS = sorted(w for w, s, t, _ in BAD_ENTRIES if s >= 2 and 2 <= len(w) <= 3 and set(t) & set(SHORT_TAGS))
AGGRESSIVE_SHORT = sorted(w for w, s, t, _ in BAD_ENTRIES if w in SHORT_WORDS and set(t) & set(AGGRESSIVE_TAGS))
CLEAN_SET = sorted(w for w in CLEAN_WORDS if w not in BAD_WORDS and w not in WHITELIST and 3 <= len(w) <= 24)


def words(spark: SparkSession, values: list[str], name: str = "word") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def skeleton(word: str) -> str:
    """The word without vowels, or the word if fewer than two letters are left."""
    rest = "".join(c for c in word if c not in "aeiou")
    return rest if len(rest) >= 2 else word


def bad_index(spark: SparkSession, values: list[str] | None = None) -> DataFrame:
    """word, len, head, tail, skeleton, sk_len, sk_head of each bad word: the blocking keys of the fuzzy joins."""
    rows = [(w, len(w), w[0], w[-1], skeleton(w), len(skeleton(w)), skeleton(w)[0]) for w in (values or BAD_WORDS)]
    return spark.createDataFrame(rows, "word string, len int, head string, tail string, skeleton string, sk_len int, sk_head string")


#: Up to so many words (some 100 bytes each) are sent to every executor.
BROADCAST_WORDS = 200_000
KINDS = ("bad", "white", "clean", "short", "aggressive", "trigger")


@dataclass(frozen=True)
class Weights:
    """The decision model: weights of the signals and the bias, and the thresholds of review and block."""

    weights: dict[str, float]
    review: float
    block: float


SHIPPED = Weights(WEIGHTS, REVIEW_THRESHOLD, BLOCK_THRESHOLD)


@dataclass(frozen=True)
class Lexicon:
    """words: word and whether it is of each of KINDS; index: the blocking keys of bad words; raw: bad words that are looked
    for anywhere in a text; phrases: contextual phrases."""

    words: DataFrame
    index: DataFrame
    raw: list[str]
    phrases: list[str]


def indexed(bad: DataFrame) -> DataFrame:
    """word, len, head, tail, skeleton, sk_len, sk_head of each bad word: the blocking keys of the fuzzy joins."""
    w = bad.select("word", F.length("word").alias("len"), F.substring("word", 1, 1).alias("head"), F.substring("word", -1, 1).alias("tail"), X.consonants(F.col("word")).alias("skeleton"))
    return w.select("*", F.length("skeleton").alias("sk_len"), F.substring("skeleton", 1, 1).alias("sk_head"))


def of_tables(tables: dict[str, DataFrame], phrases: list[str], most_raw: int = 500_000) -> Lexicon:
    """The lexicon of one-column tables of words by kind (of KINDS; a missing kind has none; `whitelist` is white), such as
    those of sources.scans.moderation_db.  A word that is bad or whitelisted is not clean."""
    spark = next(iter(tables.values())).sparkSession
    tables = {"white" if k == "whitelist" else k: t for k, t in tables.items()}
    rows = reduce(DataFrame.unionByName, [t.select(F.col("word"), F.lit(k).alias("kind")) for k, t in tables.items()])
    flags = {k: F.bool_or(F.col("kind") == k) for k in KINDS}
    wide = rows.groupBy("word").agg(*[c.alias(k) for k, c in flags.items()]).withColumn("clean", F.col("clean") & ~F.col("bad") & ~F.col("white"))
    raw = [r.word for r in tables["bad"].select("word").distinct().limit(most_raw + 1).collect()] if "bad" in tables else []
    if len(raw) > most_raw:
        raise ValueError(f"more than {most_raw} bad words")
    index = indexed(tables["bad"].select("word").distinct() if "bad" in tables else words(spark, []))
    few = wide.count() <= BROADCAST_WORDS
    return Lexicon(F.broadcast(wide) if few else wide, F.broadcast(index) if few else index, sorted(raw), sorted(phrases))


def project(spark: SparkSession) -> Lexicon:
    """The lexicon of the project's own lists."""
    lists = dict(zip(KINDS, (BAD_WORDS, WHITELIST, CLEAN_SET, SHORT_WORDS, AGGRESSIVE_SHORT, TRIGGER_TOKENS)))
    every = sorted(set().union(*lists.values()))
    rows = [(w, *[w in v for v in lists.values()]) for w in every]
    return Lexicon(F.broadcast(spark.createDataFrame(rows, "word string, " + ", ".join(f"{k} boolean" for k in KINDS))), F.broadcast(bad_index(spark)), BAD_WORDS, sorted(PHRASES))
