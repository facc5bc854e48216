"""Mining of toxic contexts, phrases and contrastive turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modwarden import lexicon
from modwarden.functions import text as X

#: Stems of insults and phrases looked for without word borders.
STEMS = ["t+r+a+s+h+", "s+c+u+m+", "m+o+r+o+n+", "i+d+i+o+t+", "l+o+s+e+r+"]
TOXIC_PHRASES = ["worthless", "pathetic", "disgusting", "stupid", "get lost", "shut up"]
MIN_CONTEXT = 12


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def toxic_terms(cleaned: Column) -> Column:
    """Known bad words of a text, sorted; only if there are none, words with an insult's stem that are not whitelisted."""
    words = X.letter_words(cleaned)
    seed = F.array_sort(F.array_distinct(F.array_intersect(words, _array(lexicon.BAD_WORDS))))
    stem = F.filter(words, lambda w: w.rlike("|".join(STEMS)) & ~w.isin(*lexicon.WHITELIST))
    return F.when(F.size(seed) > 0, seed).otherwise(F.array_sort(F.array_distinct(stem)))


def turn_terms(cleaned: Column) -> Column:
    """The toxic terms of a user's turn.  If there are none and a toxic phrase stands anywhere in it, its words of three
    letters that are not whitelisted, sorted, or `toxic_phrase` if it has no such word."""
    words = F.array_sort(F.array_distinct(F.filter(X.letter_words(cleaned), lambda w: (F.length(w) >= 3) & ~w.isin(*lexicon.WHITELIST))))
    some = F.when(F.size(words) > 0, words).otherwise(_array(["toxic_phrase"]))
    known = toxic_terms(cleaned)
    return F.when((F.size(known) == 0) & F.lower(cleaned).rlike("|".join(TOXIC_PHRASES)), some).otherwise(known)


def toxic_scores(rows: DataFrame, scores: list[str], predicate: list[str], least: float) -> DataFrame:
    """rows with score (greatest of the score columns, 0 at least) and toxic (greatest of the predicate's columns reaches
    `least`); a column may count in the score and not in the predicate."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return rows.withColumn("score", F.greatest(F.lit(0.0), *[zero(c) for c in scores])).withColumn("toxic", F.greatest(F.lit(0.0), *[zero(c) for c in predicate]) >= least)


def contexts(docs: DataFrame, labels: DataFrame, per_source: int | None = None, most: int | None = None) -> DataFrame:
    """source, toxicity_score, profane_terms, context of labelled toxic texts: the first of each context by (source, id).

    Caps, if given, are those of the mined file: per source and over all, in that order of rows."""
    toxic = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    rows = toxic.select("doc_id", "source", X.clean_context(F.col("text")).alias("context"))
    rows = rows.where(F.length("context") >= MIN_CONTEXT).withColumn("profane_terms", toxic_terms(F.col("context"))).where(F.size("profane_terms") > 0)
    first = rows.withColumn("__rn", F.row_number().over(Window.partitionBy("context").orderBy("source", "doc_id"))).where("__rn = 1").drop("__rn")
    if per_source is not None:
        first = first.withColumn("__rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where(F.col("__rn") <= per_source).drop("__rn")
    if most is not None:
        first = first.orderBy("source", "doc_id").limit(most)
    return first.select("doc_id", "source", F.round(F.lit(1.0), 4).alias("toxicity_score"), "profane_terms", "context")


def terms(mined: DataFrame) -> DataFrame:
    """Of each term the greatest score, the first source by id, and the number of contexts."""
    one = mined.select("doc_id", "source", "toxicity_score", F.explode("profane_terms").alias("term"))
    return one.groupBy("term").agg(F.max("toxicity_score").alias("score"), F.min_by("source", "doc_id").alias("source"), F.count(F.lit(1)).alias("n"))


def phrases(docs: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct short texts that are wholly of known words (a column `word`) and hold a trigger word.

    Only texts with a trigger word are looked up, word by word."""
    rows = docs.select(X.clean_context(F.col(text_col)).alias("cleaned")).where(F.length("cleaned") >= 8)
    rows = rows.withColumn("tokens", F.filter(X.letter_words(F.col("cleaned")), lambda w: F.length(w) >= 2)).where(F.size("tokens").between(2, 24))
    rows = rows.where(F.arrays_overlap("tokens", _array(lexicon.TRIGGER_TOKENS)))
    rows = rows.select(F.array_join("tokens", " ").alias("phrase"), "tokens").where(F.length("phrase").between(8, 180)).dropDuplicates(["phrase"])
    words = known.select("word").distinct().withColumn("__known", F.lit(1))
    looked = rows.select("phrase", F.explode("tokens").alias("word")).join(words, "word", "left")
    return looked.groupBy("phrase").agg(F.count("__known").alias("k"), F.count(F.lit(1)).alias("n")).where("k = n").select("phrase")


def speaker(role: Column) -> Column:
    r = F.lower(F.trim(role))
    return F.when(r.rlike("user|human|prompter"), F.lit("user")).when(r.rlike("assistant|bot|model|gpt"), F.lit("assistant")).otherwise(r)


def in_language(rows: DataFrame, prefix: str, column: str = "language") -> DataFrame:
    """Rows whose language begins with the prefix, and rows of no known language."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    return rows.where((low == "") | low.startswith(prefix.strip().lower()))


def triplets(turns: DataFrame, is_toxic=None) -> DataFrame:
    """conv_id, turn, anchor, negative_assistant, previous_clean_user, anchor_terms of toxic user turns that an assistant
    answers.

    A turn is toxic if it has turn_terms(), or by is_toxic, where given.
    previous_clean_user is the last earlier user turn that is long enough and not toxic ('' if none); it stays when
    used.  The answer is the next user or assistant turn, if it is an assistant's.  Equal pairs count once."""
    toxic = is_toxic or (lambda c: F.size(turn_terms(c)) > 0)
    rows = turns.select("conv_id", "turn", speaker(F.col("role")).alias("role"), X.clean_context(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
    long_user = (F.col("role") == "user") & (F.length("t") >= MIN_CONTEXT)
    rows = rows.withColumn("toxic", long_user & toxic(F.col("t"))).withColumn("clean", long_user & ~F.col("toxic"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("previous_clean_user", F.coalesce(F.last(F.when(F.col("clean"), F.col("t")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit("")))
    nxt = F.first(F.when(F.col("role").isin("user", "assistant"), F.struct("role", "t")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("next", nxt).where("toxic and next.role = 'assistant'").where(F.length("next.t") >= MIN_CONTEXT)
    rows = rows.select("conv_id", "turn", F.col("t").alias("anchor"), F.col("next.t").alias("negative_assistant"), "previous_clean_user", turn_terms(F.col("t")).alias("anchor_terms"))
    pair = Window.partitionBy("anchor", "negative_assistant").orderBy("conv_id", "turn")
    return rows.withColumn("__rn", F.row_number().over(pair)).where("__rn = 1").drop("__rn")


def dictionary(*sources: DataFrame) -> DataFrame:
    """Distinct normalised words of several one-column tables."""
    every = None
    for s in sources:
        one = s.select(X.dictionary_word(F.col(s.columns[0])).alias("word")).where("word is not null")
        every = one if every is None else every.unionByName(one)
    return every.distinct()
