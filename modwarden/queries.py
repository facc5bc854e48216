"""The queries of the moderation, mining and reporting operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modwarden import lexicon, staging
from modwarden.functions import distance, hashing, signals
from modwarden.functions import text as X
from modwarden.operators import candidates, containment, lexical, seeds, vector
from modwarden.plans import cascade, mining, reports
from modwarden.source_queries import SOURCE_QUERIES
from modwarden.streaming import jobs


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _messages(spark, sf_dir):
    """Documents as messages, on all cores: the work on a text is many times that of reading it."""
    return staging.spread(read(spark, sf_dir, "documents").select("doc_id", "text"))


def _docs(spark, sf_dir):
    return _messages(spark, sf_dir).select("doc_id", X.nfkc(F.coalesce("text", F.lit(""))).alias("text"))


def _mixed(spark, sf_dir):
    """Messages of several shapes: dates, codes, names, numbers and prose."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    parts = [
        o.select(F.lit("date").alias("kind"), F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("text")),
        o.select(F.lit("priority"), "o_orderkey", "o_orderpriority"),
        o.select(F.lit("number"), "o_orderkey", F.col("o_custkey").cast("string")),
        c.select(F.lit("name"), "c_custkey", "c_name"),
        c.select(F.lit("sum"), "c_custkey", F.concat(F.col("c_nationkey").cast("string"), F.lit("+"), F.col("c_custkey").cast("string"))),
        read(spark, sf_dir, "documents").select(F.lit("prose"), "doc_id", F.coalesce("text", F.lit(""))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def normalize_documents(spark, sf_dir):
    n = X.normalized(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", n.alias("normalized"), F.length(X.compact(F.col("text"))).alias("compact_len"))


def collapse_repeats(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.collapsed(X.compact(F.col("text"))).cast("binary")).alias("collapsed_md5"))


def surface_signals(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in signals.surface(F.col("text")).items()])


def risk_signals(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", signals.high_risk_phrase(t).alias("high_risk"), signals.trigger(t).alias("trigger"), signals.link(t).alias("link"), signals.money(t).alias("money"), signals.urgency(t).alias("urgency"))


def page_signals(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return rows.select("page_id", signals.link(F.col("text")).alias("link"), F.length(X.clean_context(F.col("text"))).alias("cleaned_len"))


def context_guards(spark, sf_dir):
    t = F.col("text")
    return _mixed(spark, sf_dir).select("kind", "id", signals.date_like(t).alias("date_like"), signals.numeric_noise(t).alias("numeric_noise"), signals.code_like(t).alias("code_like"), signals.math_like(t).alias("math_like"))


def fallback_gate(spark, sf_dir):
    rows = _docs(spark, sf_dir)
    return rows.select("doc_id", signals.fallback_gate(F.col("text"), signals.surface(F.col("text"))).alias("gate"))


def _extracted(spark, sf_dir):
    return candidates.with_candidates(_messages(spark, sf_dir))


def strict_candidates(spark, sf_dir):
    return lexical.exploded(_extracted(spark, sf_dir), "doc_id", "strict")


def merged_candidates(spark, sf_dir):
    return lexical.exploded(_extracted(spark, sf_dir), "doc_id", "merged")


def exact_hits(spark, sf_dir):
    cand = lexical.exploded(_extracted(spark, sf_dir), "doc_id", "strict").where(F.length("token") >= lexical.MIN_MATCH)
    bad, white = lexicon.words(spark, lexicon.BAD_WORDS, "token"), lexicon.words(spark, lexicon.WHITELIST, "token")
    return cand.join(F.broadcast(bad), "token", "left_semi").join(F.broadcast(white), "token", "left_anti").select("doc_id", "token", "obfuscated")


def substring_scan(spark, sf_dir):
    lex = lexicon.project(spark)
    rows = _extracted(spark, sf_dir)
    hits = rows.where(lexical.raw_hit(F.coalesce("text", F.lit("")), lex.raw) | lexical.raw_hit(X.normalized(F.coalesce("composed", F.lit(""))), lex.raw))
    return lexical.native_valid(hits, "doc_id", lex.words)


def _tokens(spark, sf_dir):
    return lexical.flagged(lexical.exploded(_extracted(spark, sf_dir), "doc_id", "merged"), lexicon.project(spark).words)


def fuzzy_strong(spark, sf_dir):
    pairs = lexical.fuzzy_pairs(_tokens(spark, sf_dir), lexicon.project(spark).index).where("fuzzy_word is not null")
    return pairs.where(distance.within_one(F.col("token"), F.col("fuzzy_word"))).select("doc_id", "token", F.col("fuzzy_word").alias("bad_word")).distinct()


def fuzzy_weak(spark, sf_dir):
    pairs = lexical.fuzzy_pairs(_tokens(spark, sf_dir), lexicon.project(spark).index).where("fuzzy_word is not null and far = 2 and not clean")
    return pairs.withColumn("d", distance.osa(F.col("token"), F.col("fuzzy_word"))).where("d = 2").select("doc_id", "token", F.col("fuzzy_word").alias("bad_word")).distinct()


def skeleton_hits(spark, sf_dir):
    pairs = lexical.skeleton_pairs(_tokens(spark, sf_dir), lexicon.project(spark).index).where("skeleton is not null")
    return pairs.select("doc_id", "token", "skeleton").distinct()


def decision_scores(spark, sf_dir):
    rows = cascade.scored(_messages(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "matched", "is_profane", "decision", F.round("linear", 6).alias("linear"), F.round("score", 6).alias("score"))


def moderation_verdicts(spark, sf_dir):
    return cascade.verdicts(_messages(spark, sf_dir)).select("doc_id", "verdict", "reason", "decision", "score", "needs_semantic")


def semantic_verdicts(spark, sf_dir):
    """All stages; the index is of the bad words, and hashed n-grams stand in for a text embedding.

    The bars are the stand-in's own, low enough that both stages find something; its cosines are ratios of small whole
    numbers, so they lie beside round values."""
    embed = vector.hashed_ngrams()
    index = vector.bootstrapped(lexicon.words(spark, lexicon.BAD_WORDS)).select(F.xxhash64("text").alias("id"), embed(F.col("text")).alias("vector"), "category")
    return cascade.semantic_verdicts(_messages(spark, sf_dir), embed, index, profanity=0.487, general=0.237).select("doc_id", "verdict", "reason", "decision", "score", "needs_semantic")


def verdict_summary(spark, sf_dir):
    v = cascade.verdicts(_messages(spark, sf_dir))
    return v.groupBy("verdict", "reason").agg(F.count(F.lit(1)).alias("n"))


def verdict_rollup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    v = cascade.verdicts(_messages(spark, sf_dir)).join(docs.select("doc_id", "source", "lang"), "doc_id")
    return v.rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"))


def label_confusion(spark, sf_dir):
    return reports.confusion(cascade.verdicts(_messages(spark, sf_dir)), read(spark, sf_dir, "labels"))


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def knn_top1(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return vector.top1(v, v, 0.40, skip_self=True).select(F.col("id").alias("vec_id"), "match", F.round("score", 6).alias("score"))


def knn_filtered(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return vector.top1(v, v.where("label in (0, 1)"), 0.30, skip_self=True).select(F.col("id").alias("vec_id"), "match", F.round("score", 6).alias("score"))


def knn_label_counts(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    near = vector.top1(v, v, 0.40, skip_self=True)
    pairs = near.join(v.select("id", F.col("label").alias("label")), "id").join(v.select(F.col("id").alias("match"), F.col("label").alias("match_label")), "match")
    return pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("match_label")).alias("agree"))


def _corpus_words(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.explode(X.letter_words(F.col("text"))).alias("word"))


def seed_terms_round_robin(spark, sf_dir):
    return seeds.round_robin(_corpus_words(spark, sf_dir), 200, skip=lexicon.WHITELIST).select("word", F.col("turn").cast("long").alias("turn"))


def clean_lexicon_top(spark, sf_dir):
    words = _docs(spark, sf_dir).select("doc_id", F.explode(X.letter_words(F.col("text"))).alias("word"))
    out = seeds.per_letter_cap(words, 500, order_col="doc_id")
    bad, white = lexicon.words(spark, lexicon.BAD_WORDS), lexicon.words(spark, lexicon.WHITELIST)
    return out.join(F.broadcast(bad), "word", "left_anti").join(F.broadcast(white), "word", "left_anti").select("word", F.col("turn").cast("long").alias("turn"))


def fnv1a32_bloom_index(spark, sf_dir):
    n = F.col("c_name")
    return read(spark, sf_dir, "customer").select("c_custkey", hashing.fnv1a32(n).alias("fnv"), hashing.djb2(n).alias("djb"), F.array_join(F.transform(hashing.bloom_indexes(n), lambda x: x.cast("string")), ",").alias("bits"))


def stable_ids(spark, sf_dir):
    n = F.col("c_name")
    return read(spark, sf_dir, "customer").select("c_custkey", hashing.fnv1a64(n).cast("string").alias("fnv64"), hashing.uuid_of("general_scam", n).alias("uuid"))


def upsert_latest(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), "event_type")
    out = vector.upserted(e.where("version % 2 = 0"), e.where("version % 2 = 1"))
    return out.select("id", "version", "event_type")


def _mined(spark, sf_dir):
    return mining.contexts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def mined_contexts(spark, sf_dir):
    m = _mined(spark, sf_dir)
    return m.select("doc_id", "source", "toxicity_score", F.array_join("profane_terms", ",").alias("terms"), F.md5(F.col("context").cast("binary")).alias("context_md5"))


def mined_sources(spark, sf_dir):
    return _mined(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def mined_terms(spark, sf_dir):
    return mining.terms(_mined(spark, sf_dir))


def triplets(spark, sf_dir):
    """Texts with a German article stand for toxic ones, as no conversation holds an insult."""
    return mining.triplets(read(spark, sf_dir, "conversations"), lambda c: F.array_contains(X.letter_words(c), "la") | F.array_contains(X.letter_words(c), "die")).select(
        "conv_id", "turn", F.md5(F.col("anchor").cast("binary")).alias("anchor"), F.md5(F.col("negative_assistant").cast("binary")).alias("answer"), F.md5(F.col("previous_clean_user").cast("binary")).alias("clean_user")
    )


def dictionary_build(spark, sf_dir):
    return mining.dictionary(read(spark, sf_dir, "part").select("p_type"), read(spark, sf_dir, "nation").select("n_name"), lexicon.words(spark, [f" {w}* " for w in lexicon.BAD_WORDS]))


def toxic_rows(spark, sf_dir):
    """Line item rates stand for multi-label scores; one of them counts in the score only."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("b"), (F.col("l_quantity") / 50).alias("threat"))
    out = mining.toxic_scores(rows, ["a", "b", "threat"], ["a", "b"], 0.5)
    return out.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 4).alias("top"), F.round(F.min("score"), 4).alias("low"))


def label_states(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in ("toxic", "Non-toxic", "0", "1", "neutral", "maybe", "offensive", "not hate")]), (F.col("p_size") % 8 + 1).cast("int")).alias("label"))
    return rows.select("p_partkey", "label", signals.label_state(F.col("label")).alias("state"))


def phrase_containment(spark, sf_dir):
    """Benchmark passages in documents."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return containment.passages_in(_messages(spark, sf_dir), items)


def question_sentences(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.question_count(F.coalesce("text", F.lit(""))).alias("questions"), F.length(X.shortened(F.col("text"), 40)).alias("shown"))


def _events(f):
    return lambda spark, sf_dir: f(read(spark, sf_dir, "events"))


def event_stream(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet") if sf_dir_is_folder(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def streaming_daily_activity(spark, sf_dir):
    return jobs.drained(jobs.daily_counts(event_stream(spark, sf_dir)))


def sf_dir_is_folder(spark, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def admin_channels(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    admins = spark.createDataFrame([(1, 2), (1, 5), (2, 3)], "user_id long, channel_id long")
    return reports.for_admin(reports.channel_rollup(events), admins, 1).select("channel_id", "scanned", "blocked")


QUERIES = {
    f.__name__: f
    for f in (
        normalize_documents, collapse_repeats, surface_signals, risk_signals, page_signals, context_guards, fallback_gate, strict_candidates, merged_candidates, exact_hits, substring_scan,
        fuzzy_strong, fuzzy_weak, skeleton_hits, decision_scores, moderation_verdicts, semantic_verdicts, verdict_summary, verdict_rollup, label_confusion, knn_top1, knn_filtered, knn_label_counts,
        seed_terms_round_robin, clean_lexicon_top, fnv1a32_bloom_index, stable_ids, upsert_latest, mined_contexts, mined_sources, mined_terms, triplets, dictionary_build,
        toxic_rows, label_states, phrase_containment, question_sentences, streaming_daily_activity, admin_channels,
    )
}
QUERIES |= {
    "channel_rollup": _events(reports.channel_rollup),
    "overview_totals": _events(reports.overview),
    "offender_rollup": _events(reports.offenders),
    "top_offenders": _events(lambda e: reports.top_offenders(e, 50)),
    "top_words": _events(lambda e: reports.top_words(e, 10)),
    "recent_events": _events(lambda e: reports.recent(e, 8)),
    "distinct_offenders": _events(reports.distinct_offenders),
    "daily_activity": _events(reports.daily),
}

QUERIES |= SOURCE_QUERIES
