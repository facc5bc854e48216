"""Lexical evidence of messages: exact, fuzzy and skeleton matches of candidates against a lexicon.

Candidates are exploded, joined with the lexicon's tables and aggregated by message, so nothing of a lexicon but the list
of raw words and the phrases is part of a plan.  The only shuffle is of one partly aggregated row a message.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modwarden import lexicon
from modwarden.functions import distance, hashing
from modwarden.functions import text as X

MIN_MATCH = 4
#: Raw words that one pattern may hold; more of them are looked for by an automaton.
PATTERN_WORDS = 500


def exploded(rows: DataFrame, id_col: str, stream: str) -> DataFrame:
    """One row a candidate of a stream (strict, collapsed or merged): id, pos, token, obfuscated."""
    one = rows.select(F.col(id_col), F.posexplode("candidates").alias("pos", "c")).where(F.col(f"c.{stream}").isNotNull())
    return one.select(id_col, "pos", F.col("c.text").alias("token"), F.col(f"c.{stream}").alias("obfuscated"))


def flagged(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Rows with a token and what the lexicon says of it; a word that is bad or whitelisted is never clean."""
    off = F.lit(False)
    known = tokens.join(words, tokens["token"] == words["word"], "left").drop("word").withColumns({k: F.coalesce(k, off) for k in lexicon.KINDS})
    return known.withColumn("clean", F.col("clean") & ~F.col("bad") & ~F.col("white"))


def reach(token: Column, obfuscated: Column) -> Column:
    """How far a fuzzy match may be."""
    return F.when(obfuscated & (F.length(token) > MIN_MATCH + 1), F.lit(2)).otherwise(F.lit(1))


def fuzzy_pairs(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """Flagged candidates with the bad words that share first and last letter and may be near enough; others keep nulls."""
    n = F.length("token")
    far = reach(F.col("token"), F.col("obfuscated"))
    eligible = (n >= MIN_MATCH) & (n <= X.TOKEN_MAX) & ~F.col("white") & ~(F.col("clean") & ~F.col("obfuscated")) & (F.col("obfuscated") | (n <= 6))
    keyed = candidates.withColumns({"first": F.when(eligible, F.substring("token", 1, 1)), "final": F.when(eligible, F.substring("token", -1, 1)), "far": far})
    near = (F.col("first") == F.col("b.head")) & (F.col("final") == F.col("b.tail"))
    window = (F.col("b.len") >= F.greatest(F.lit(MIN_MATCH), n - F.col("far"))) & (F.col("b.len") <= n + F.col("far"))
    pairs = keyed.join(index.select("word", "len", "head", "tail").alias("b"), near & window & distance.may_be_within(F.col("token"), F.col("b.word"), 2), "left")
    return pairs.select(*[keyed[c] for c in candidates.columns], F.col("b.word").alias("fuzzy_word"), "far")


def skeleton_pairs(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """Candidates with the skeletons of bad words that are within one edit of their own; others keep nulls."""
    own = X.consonants(F.col("token"))
    n = F.length("token")
    eligible = (n >= MIN_MATCH) & (n <= X.TOKEN_MAX) & F.col("obfuscated") & ~F.col("white") & ~F.col("clean") & (F.length(own) >= MIN_MATCH - 1)
    keyed = candidates.withColumn("own", F.when(eligible, own))
    bones = index.select("skeleton", "sk_len", "sk_head").distinct().alias("s")
    size = F.col("s.sk_len").between(F.greatest(F.lit(MIN_MATCH - 1), F.length("own") - 1), F.length("own") + 1)
    pairs = keyed.join(bones, (F.substring("own", 1, 1) == F.col("s.sk_head")) & size & distance.within_one(F.col("own"), F.col("s.skeleton")), "left")
    return pairs.select(*[keyed[c] for c in candidates.columns], F.col("s.skeleton").alias("skeleton"))


def evidence(rows: DataFrame, lex: lexicon.Lexicon) -> DataFrame:
    """Messages with what the lexicon says of their candidates and tokens; the arrays and texts are dropped.

    rows has candidates, tokens (an array, empty where no phrase stands), short (whether vector candidates are wanted at
    all) and odd (the signs by which plain words are), and columns that stay, as one row a message.
    The columns are native, acronym (any aggressive short word), acronym_odd (any of three letters, which counts
    in a text of odd signs), skip, all_clean, phrase_ok, probes, and of candidates of at least four letters exact, fuzzy_strong,
    fuzzy_weak, skeleton, obfuscated, likely_clean, short_token, long_token; an exact match leaves the later ones unset.
    """
    kept = [c for c in rows.columns if c not in ("candidates", "tokens")]
    none = F.lit(None).cast("boolean")
    as_item = lambda text, strict, collapsed, merged, token: F.struct(text.alias("text"), strict.alias("strict"), collapsed.alias("collapsed"), merged.alias("merged"), token.alias("token"))
    items = F.concat(F.transform("candidates", lambda c: as_item(c["text"], c["strict"], c["collapsed"], c["merged"], F.lit(False))), F.transform("tokens", lambda t: as_item(t, none, none, none, F.lit(True))))
    # a message is a row of its own, whatever its id
    one = rows.withColumn("__row", F.monotonically_increasing_id()).select("__row", *kept, F.posexplode_outer(items).alias("pos", "__item"))
    item = lambda name: F.col(f"__item.{name}")
    # only what is looked up in the merged list of four letters on takes part in the fuzzy joins, which skip nulls
    looked = item("merged").isNotNull() & (F.length(item("text")) >= MIN_MATCH)
    one = one.select("__row", *kept, "pos", item("text").alias("token"), item("strict").alias("strict"), item("collapsed").alias("collapsed"), item("token").alias("is_token"), F.when(looked, item("merged")).alias("obfuscated"), item("merged").alias("merged"))
    pairs = skeleton_pairs(fuzzy_pairs(flagged(one, lex.words), lex.index), lex.index)
    d = F.when(F.col("fuzzy_word").isNotNull(), distance.osa(F.col("token"), F.col("fuzzy_word")))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    n, strict, bad, white, clean = F.length("token"), F.col("strict").isNotNull(), F.col("bad"), F.col("white"), F.col("clean")
    looked = F.col("obfuscated").isNotNull()
    short = strict & F.col("short") & ~white & n.between(2, MIN_MATCH - 1)
    skip = strict & ~F.col("trigger") & n.between(MIN_MATCH, X.TOKEN_MAX) & (white | (~bad & ~F.col("strict") & clean))
    probe = F.col("few") & (F.col("pos") < 32) & F.col("merged").isNotNull() & n.between(MIN_MATCH, X.TOKEN_MAX) & ~bad & ~white & ~clean & (F.col("merged") | F.col("odd"))
    is_token = F.col("is_token")
    seen = pairs.withColumn("d", d).groupBy("__row", *kept).agg(
        some(strict & (n >= MIN_MATCH) & bad & ~white | F.coalesce("collapsed", F.lit(False)) & (n >= MIN_MATCH) & bad & ~white).alias("native"),
        some(short & F.col("aggressive")).alias("acronym"),
        some(short & (n == 3)).alias("acronym_odd"),
        F.max(F.when(strict, F.col("pos"))).alias("__strict"),
        some(skip).alias("__skip"),
        some(strict & ~(~F.col("strict") & (n >= MIN_MATCH) & clean)).alias("__unclean"),
        some(is_token & F.col("trigger")).alias("__trigger"),
        some(is_token & (bad | ~(white | clean))).alias("__unknown"),
        F.slice(F.transform(F.array_sort(F.collect_set(F.when(probe, F.struct("pos", "token")))), lambda p: p["token"]), 1, 8).alias("probes"),
        F.min(F.when(looked, n)).alias("min_len"),
        some(looked & F.col("obfuscated")).alias("obfuscated"),
        some(looked & bad & ~white).alias("exact"),
        some(looked & clean).alias("likely_clean"),
        some(looked & (F.col("d") <= 1)).alias("fuzzy_strong"),
        some(looked & (F.col("d") == 2) & (F.col("far") == 2) & F.col("obfuscated") & ~clean).alias("fuzzy_weak"),
        some(looked & F.col("skeleton").isNotNull()).alias("skeleton"),
    )
    seen = seen.withColumns({c: F.col(c) & ~F.col("exact") for c in ("likely_clean", "fuzzy_strong", "fuzzy_weak", "skeleton")})
    has = F.col("__strict").isNotNull()
    seen = seen.withColumns({
        "skip": F.coalesce(F.col("__strict") == 0, F.lit(False)) & F.col("__skip"),
        "all_clean": has & ~F.col("__unclean"),
        "phrase_ok": has & F.col("__trigger") & ~F.col("__unknown"),
        "short_token": F.coalesce(F.col("min_len") <= MIN_MATCH + 1, F.lit(False)),
        "long_token": F.coalesce(F.col("min_len").between(8, 98), F.lit(False)),
    })
    return seen.drop("__row", "__strict", "__skip", "__unclean", "__trigger", "__unknown", "min_len")


@lru_cache(maxsize=4)
def _automaton(words: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, True)
    out.make_automaton()
    return out


def raw_hit(text: Column, values: list[str]) -> Column:
    """Whether a bad word, of plain letters, stands anywhere in the text, word borders or not."""
    if not values:
        return F.lit(False)
    low = X.ascii_lower(text)
    if len(values) <= PATTERN_WORDS:
        return low.rlike("|".join(values))
    words = tuple(values)

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        known = _automaton(words)
        return pa.array([t is not None and next(known.iter(t), None) is not None for t in texts.to_pylist()], pa.bool_())

    return found(low)


def native_valid(rows: DataFrame, id_col: str, words: DataFrame) -> DataFrame:
    """id and valid: whether a candidate, strict or obfuscated collapsed, is itself a bad word.  Ids are distinct."""
    one = rows.select(F.col(id_col), F.explode_outer("candidates").alias("c")).select(id_col, F.col("c.text").alias("token"), F.coalesce(F.col("c.strict").isNotNull() | F.col("c.collapsed"), F.lit(False)).alias("counts"))
    return flagged(one, words).groupBy(id_col).agg(F.coalesce(F.bool_or(F.col("counts") & (F.length("token") >= MIN_MATCH) & F.col("bad") & ~F.col("white")), F.lit(False)).alias("valid"))


def phrase_in(tokens: Column, phrases: list[str]) -> Column:
    """The first of the sorted phrases that stands in 2 to 48 tokens, else null."""
    padded = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    known = F.array(*[F.lit(p) for p in phrases]).cast("array<string>")
    found = F.filter(known, lambda p: padded.contains(F.concat(F.lit(" "), p, F.lit(" "))))
    return F.when(F.size(tokens).between(2, 48) & (F.size(found) > 0), F.array_min(found))


def bloom(words: DataFrame) -> DataFrame:
    """bit: the set bits of the Bloom filter of a column `word`."""
    return words.select(F.explode(hashing.bloom_indexes(F.col("word"))).alias("bit")).distinct()


def maybe_known(words: DataFrame, bits: DataFrame) -> DataFrame:
    """Distinct words of four letters or more all of whose bits are set: those of the filter, and the odd other one."""
    one = words.select("word").where(F.length("word") >= MIN_MATCH).distinct().select("word", F.explode(F.array_distinct(hashing.bloom_indexes(F.col("word")))).alias("bit"))
    seen = one.join(bits.withColumn("__set", F.lit(1)), "bit", "left").groupBy("word").agg(F.count("__set").alias("k"), F.count(F.lit(1)).alias("n"))
    return seen.where("k = n").select("word")
