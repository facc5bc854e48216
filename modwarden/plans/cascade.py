"""The moderation cascade: the first decisive stage gives verdict and reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modwarden import lexicon, staging
from modwarden.functions import hashing, signals
from modwarden.functions import text as X
from modwarden.operators import candidates, lexical, vector

EVIDENCE = ("exact", "fuzzy_strong", "fuzzy_weak", "skeleton", "obfuscated", "likely_clean", "short_token", "long_token")


def scored(messages: DataFrame, id_col: str = "doc_id", text_col: str = "text", lex: lexicon.Lexicon | None = None, model: lexicon.Weights = lexicon.SHIPPED) -> DataFrame:
    """Messages with signals, evidence, linear, score, decision, matched and is_profane of the lexical stages.

    Each row is a message of its own; null texts count as empty.  lex is the lexicon, the project's where none is given."""
    lex = lex or lexicon.project(messages.sparkSession)
    rows = messages.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    rows = candidates.with_candidates(rows, "raw").withColumnRenamed("composed", "text")
    text = F.col("text")
    rows = rows.withColumns(signals.surface(text, F.col("raw")) | {"high_risk": signals.high_risk_phrase(text), "phrase": lexical.phrase_in(X.ascii_tokens(text), lex.phrases)})
    hits = lexical.raw_hit(F.col("raw"), lex.raw) | lexical.raw_hit(X.normalized(text), lex.raw)
    leet, hard = F.col("leet"), F.col("hard_separator")
    guards = {"date_like": signals.date_like, "noise": signals.numeric_noise, "code_like": signals.code_like, "math_like": signals.math_like}
    more = {
        "raw_hit": hits,
        "tokens": F.when(F.col("phrase").isNotNull(), X.ascii_tokens(text)).otherwise(F.array().cast("array<string>")),
        "few": (F.regexp_count(text, F.lit(r"(?U)\S+")) <= 8) | leet | hard,
        "odd": leet | hard | F.col("digit"),
        "gate": signals.fallback_gate(text, {"leet": leet, "hard_separator": hard}),
    }
    rows = rows.withColumns(more | {k: f(text) for k, f in guards.items()}).drop("raw", "text")
    both = lexical.evidence(rows, lex).drop("few", "odd")
    both = both.withColumns({"native": F.col("native") & F.col("raw_hit"), "acronym": F.col("acronym") | (F.col("acronym_odd") & (leet | hard))}).drop("raw_hit", "acronym_odd")
    # the heuristic is not asked about one plain clean word
    asked = F.col("native") | F.col("acronym") | ~F.col("alpha_only") | ~F.col("all_clean")
    both = both.withColumns({c: F.col(c) & asked for c in EVIDENCE} | {"phrase": F.when(F.col("phrase_ok"), F.col("phrase"))}).drop("phrase_ok", "all_clean")
    both = both.withColumn("matched", F.col("exact") | F.col("fuzzy_strong") | F.col("fuzzy_weak") | F.col("skeleton"))
    guarded = ~F.col("native") & ~F.col("acronym") & F.col("matched") & (F.col("date_like") | F.col("noise") | F.col("code_like") | (F.col("math_like") & ~F.col("exact") & ~F.col("fuzzy_strong")))
    both = both.withColumn("guarded", guarded)
    both = both.withColumns({c: F.col(c) & ~F.col("guarded") for c in ("exact", "fuzzy_strong", "fuzzy_weak", "skeleton", "matched")} | {"likely_clean": F.col("likely_clean") & ~F.col("native"), "native_exact": F.col("native")})
    linear = F.lit(model.weights["bias"])
    for name, w in model.weights.items():
        if name != "bias":
            linear = linear + F.when(F.col(name), F.lit(w)).otherwise(F.lit(0.0))
    both = both.withColumn("linear", F.when(F.col("high_risk"), F.lit(8.0)).otherwise(linear))
    both = both.withColumn("score", F.when(F.col("high_risk"), F.lit(1.0)).otherwise(hashing.sigmoid(F.col("linear"))))
    both = both.withColumn("matched", F.col("high_risk") | F.col("acronym") | F.col("native") | F.col("matched"))
    call = F.when(~F.col("matched"), F.lit("allow")).when(F.col("high_risk") | F.col("acronym"), F.lit("block")).otherwise(hashing.decision(F.col("score"), model.review, model.block))
    return both.withColumn("decision", call).withColumn("is_profane", F.col("decision") == "block")


def verdicts(messages: DataFrame, id_col: str = "doc_id", text_col: str = "text", lex: lexicon.Lexicon | None = None, model: lexicon.Weights = lexicon.SHIPPED) -> DataFrame:
    """id, verdict, reason, decision, score and needs_semantic of each message, by the lexical stages.

    A lexical match that does not block ends the cascade as allowed.  needs_semantic marks the unresolved messages that
    the vector stage would look at; without vectors they are allowed (see semantic_verdicts).
    """
    return _lexical(messages, id_col, text_col, lex, model).drop("probes")


def _lexical(messages: DataFrame, id_col: str, text_col: str, lex: lexicon.Lexicon | None = None, model: lexicon.Weights = lexicon.SHIPPED) -> DataFrame:
    """The columns of verdicts() and probes, the candidates that an unresolved message is compared by."""
    rows = scored(messages, id_col, text_col, lex, model)
    reason = F.when(F.col("skip"), F.lit("lexical_skip")).when(F.col("matched"), F.lit("lexical_match")).when(F.col("phrase").isNotNull(), F.lit("contextual_whitelist_phrase")).otherwise(F.lit("no_lexical_or_semantic_hit"))
    rows = rows.withColumn("reason", reason)
    blocked = ((F.col("reason") == "lexical_match") & F.col("is_profane")) | (F.col("reason") == "contextual_whitelist_phrase")
    return rows.select(
        F.col("id").alias(id_col),
        F.when(blocked, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
        "reason",
        "decision",
        F.round("score", 6).alias("score"),
        ((F.col("reason") == "no_lexical_or_semantic_hit") & F.col("gate")).alias("needs_semantic"),
        F.when(F.col("reason") == "no_lexical_or_semantic_hit", F.col("probes")).otherwise(F.array().cast("array<string>")).alias("probes"),
    )


def probed(messages: DataFrame, id_col: str = "doc_id", text_col: str = "text", lex: lexicon.Lexicon | None = None) -> DataFrame:
    """id and probes of messages: the words that an unresolved one is compared by."""
    return _lexical(messages, id_col, text_col, lex).select(id_col, "probes")


def with_semantic(decided: DataFrame, vectors: DataFrame, index: DataFrame, threshold: float = 0.65, id_col: str = "doc_id") -> DataFrame:
    """Verdicts with the vector stage: unresolved messages whose nearest indexed vector reaches the threshold are blocked.

    vectors are (id, vector) of messages; only those of unresolved messages are searched."""
    open_ = decided.where("needs_semantic").select(F.col(id_col).alias("id"))
    near = vector.top1(vectors.join(open_, "id", "left_semi"), index, threshold).select(F.col("id").alias(id_col), F.lit(True).alias("__hit"))
    rows = decided.join(near, id_col, "left")
    hit = F.coalesce("__hit", F.lit(False))
    return rows.withColumn("verdict", F.when(hit, F.lit("block")).otherwise(F.col("verdict"))).withColumn("reason", F.when(F.col("needs_semantic"), F.lit("semantic_fallback")).otherwise(F.col("reason"))).drop("__hit")


def with_profanity(decided: DataFrame, embed, index: DataFrame, threshold: float = 0.80, id_col: str = "doc_id") -> DataFrame:
    """Verdicts with the stage before the fallback: an unresolved message is blocked if the vector of any of its probes
    reaches the threshold with an indexed one of a profanity category.

    index is (id, vector, category), embed gives a text's vector.  Every different probe is searched once."""
    asked = decided.where(F.size("probes") > 0).select(F.col(id_col).alias("__id"), F.explode("probes").alias("probe"))
    words = asked.select("probe").distinct().withColumn("id", F.xxhash64("probe"))
    known = index.where(F.col("category").isin(*vector.PROFANITY)).select("id", "vector")
    near = vector.top1(words.select("id", embed(F.col("probe")).alias("vector")), known, threshold).select("id")
    hits = asked.join(words.join(near, "id", "left_semi"), "probe", "left_semi").select("__id").distinct().withColumn("__hit", F.lit(True))
    rows = decided.join(hits, F.col(id_col).eqNullSafe(F.col("__id")), "left").drop("__id")
    hit = F.coalesce("__hit", F.lit(False))
    changed = {"verdict": F.when(hit, F.lit("block")).otherwise(F.col("verdict")), "reason": F.when(hit, F.lit("semantic_profanity")).otherwise(F.col("reason")), "needs_semantic": F.col("needs_semantic") & ~hit}
    return rows.withColumns(changed).drop("__hit")


def semantic_verdicts(messages: DataFrame, embed, index: DataFrame, id_col: str = "doc_id", text_col: str = "text", profanity: float = 0.80, general: float = 0.65) -> DataFrame:
    """verdicts() by all stages: the lexical ones, profanity by vector, and the vector fallback over the whole index.

    index is (id, vector, category), embed an expression of a text's vector.  Only texts that reach a stage are embedded."""
    decided = staging.staged(_lexical(messages, id_col, text_col))
    decided = staging.staged(with_profanity(decided, embed, index, profanity, id_col).drop("probes"))
    open_ = decided.where("needs_semantic").select(F.col(id_col).alias("id"))
    texts = messages.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(open_, "id", "left_semi")
    return with_semantic(decided, texts.select("id", embed(F.col("text")).alias("vector")), index.select("id", "vector"), general, id_col)


def verdicts_once(messages: DataFrame, id_col: str = "doc_id", text_col: str = "text", lex: lexicon.Lexicon | None = None) -> DataFrame:
    """verdicts(), each different text judged once: for message streams in which the same texts come again and again.

    Texts meet by 128 bits of hash; a text of a third of all rows is joined to one small row, which adaptive execution
    splits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(3), text, F.octet_length(text)).alias("b"))
    keyed = messages.select(F.col(id_col), key.alias("__key"), text.alias("__text"))
    one = keyed.groupBy("__key").agg(F.first("__text").alias("__text"))
    judged = verdicts(one, "__key", "__text", lex)
    return keyed.drop("__text").join(judged, "__key").drop("__key")
