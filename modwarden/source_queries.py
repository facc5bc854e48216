"""Queries of sources, sinks, corpora and streams: each writes what it scans to the shared folder, from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from modwarden import lexicon, staging
from modwarden.functions import hashing
from modwarden.functions import text as X
from modwarden.operators import candidates, lexical, vector
from modwarden.plans import cascade, corpora, mining, reports
from modwarden.sources import scans, sinks
from modwarden.streaming import jobs

#: Labels of whole texts that are broadcast, counted first; with more of them the join shuffles the texts, once.
BROADCAST_LABELS = 1_000_000


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _written(spark, name, write):
    """The folder that write(path) wrote."""
    path = staging.scratch(spark, name)
    write(path)
    return path


def word_file_scan(spark, sf_dir):
    """Sorted words to text files and back."""
    words = read(spark, sf_dir, "part").select(F.concat(F.lit("  "), F.col("p_type"), F.lit(" ")).alias("word"))
    path = _written(spark, "words", lambda p: sinks.sorted_lines(words, p))
    return scans.lines(spark, path).select("line", F.length("line").alias("n"))


def whitelist_scan(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    rows = c.select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("# "), "c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), F.col("c_mktsegment"), (F.col("c_custkey") % 7).cast("string"))).otherwise(F.lit("  ")).alias("word"))
    return scans.whitelist(spark, _written(spark, "whitelist", lambda p: sinks.sorted_lines(rows, p)))


def context_phrase_scan(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[.]")).alias("word"))
    return scans.context_phrases(spark, _written(spark, "phrases", lambda p: sinks.sorted_lines(rows, p)))


def _database(spark, sf_dir):
    """A moderation database a region: names as matches, variants and arrays, keys as tags and severities."""
    n = read(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey"))
    word = F.when(F.col("k") % 2 == 0, F.to_json(F.array(F.concat("n_name", F.lit("x")), F.substring("n_name", 1, 3)))).otherwise(F.concat(F.lit('"'), F.substring("n_name", 1, 2), F.lit('"')))
    tags = F.when(F.col("k") % 3 == 0, F.lit('["Acronym", "hate"]')).when(F.col("k") % 3 == 1, F.lit('["short-acronym"]')).otherwise(F.lit("[]"))
    severity = F.when(F.col("k") % 5 != 4, F.concat(F.lit(', "severity": '), (F.col("k") % 5).cast("string"))).otherwise(F.lit(""))
    entry = F.concat(F.lit('{"match": "'), "n_name", F.lit(" | "), F.lower("n_name"), F.lit('s", "word": '), word, F.lit(', "tags": '), tags, severity, F.lit("}"))
    white = F.concat(F.lit('"'), F.initcap("n_name"), F.lit('"'))
    slang = F.concat(F.lit('"'), F.substring("n_name", 1, 4), F.lit('q": "x"'))
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ", ")
    whole = n.groupBy("n_regionkey").agg(F.concat(F.lit('{"entries": ['), listed(entry), F.lit('], "whitelist": ['), listed(white), F.lit('], "slangMap": {'), listed(slang), F.lit("}}")).alias("value"))
    return whole.select("value").unionByName(spark.createDataFrame([("broken {",)], "value string"))


def moderation_db_words(spark, sf_dir):
    out = None
    for kind, words in scans.moderation_db(_database(spark, sf_dir)).items():
        part = words.select(F.lit(kind).alias("kind"), "word")
        out = part if out is None else out.unionByName(part)
    return out


def scanned_lexicon(spark, sf_dir):
    """The flags and the index that the cascade looks up, of the scanned database."""
    lex = lexicon.of_tables(scans.moderation_db(_database(spark, sf_dir)), [])
    return lex.words.join(lex.index, "word", "left").select("word", "bad", "white", "short", "aggressive", "skeleton", "sk_len")


def legacy_words(spark, sf_dir):
    """The union of two bad-word lists, and the fallback where there are none."""
    n = read(spark, sf_dir, "nation")
    one = scans.legacy(n.select(F.col("n_name").alias("word"), F.element_at(F.array(F.lit("en"), F.lit("EN"), F.lit("fr"), F.lit(None).cast("string")), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("lang"), F.when(F.col("n_nationkey") % 5 > 0, F.col("n_nationkey") % 5).cast("int").alias("severity")))
    region = read(spark, sf_dir, "region").select(F.lower("r_name").alias("word"))
    every = scans.bad_words(one, region, fallback=region).select(F.lit("union").alias("kind"), "word")
    return every.unionByName(scans.bad_words(one.limit(0), fallback=region).select(F.lit("fallback").alias("kind"), "word"))


def decision_overlay(spark, sf_dir):
    """Decision models with thresholds by region, some out of range or the wrong way round."""
    raw = read(spark, sf_dir, "region").select("r_regionkey", F.when(F.col("r_regionkey") == 4, F.lit("broken")).otherwise(F.to_json(F.struct((F.col("r_regionkey") * 0.5 - 0.2).alias("reviewThreshold"), F.when(F.col("r_regionkey") != 3, F.lit(0.3)).alias("blockThreshold"), F.struct(F.col("r_regionkey").cast("double").alias("fuzzyStrong"), F.lit(9.0).alias("unheard")).alias("features")))).alias("value"))
    out = scans.decision_model(raw)
    return out.select("r_regionkey", F.round("review", 6).alias("review"), F.round("block", 6).alias("block"), F.explode("weights").alias("feature", "weight"))


def labelled_corpora(spark, sf_dir):
    """Small corpora of each kind, made of the labels table, by the first split that is there."""
    l = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")  # noqa: E741
    d, name = F.col("doc_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    null, tenth = F.lit(None).cast("double"), (d % 10) / F.lit(10.0)
    made = {
        "jigsaw": [F.lit(" ").alias("comment_text"), name.alias("text"), (F.col("toxic") * 0.9).alias("toxic"), (F.col("quality") * 0.95).alias("threat"), tenth.alias("insult")],
        "real_toxicity": [F.struct(F.when(d % 3 > 0, name).alias("text"), ((d % 7) / F.lit(6.0)).alias("toxicity")).alias("prompt"), F.struct(F.concat(name, F.lit(" on")).alias("text"), ((d % 5) / F.lit(4.0)).alias("profanity")).alias("continuation")],
        "civil_comments": [name.alias("text"), tenth.cast("string").alias("toxicity"), F.when(d % 4 == 0, F.lit(0.7)).otherwise(null).alias("identity_attack")],
        "berkeley_hate_score": [name.alias("comment"), (tenth - 0.3).alias("hate_speech_score")],
        "tdavidson": [name.alias("tweet"), F.when(d % 11 > 0, d % 3).alias("class"), (d % 4).alias("label")],
        "tdavidson_setfit": [name.alias("text"), F.element_at(F.array(*[F.lit(x) for x in ("Hate speech", "neither", "", "other")]), (d % 4 + 1).cast("int")).alias("label_text"), (d % 3).alias("label")],
        "binary_label_setfit": [name.alias("text"), F.element_at(F.array(*[F.lit(x) for x in ("noHate", "1", "0", "unsure")]), (d % 4 + 1).cast("int")).alias("label_text"), F.col("toxic").cast("string").alias("label")],
        "binary_label_tweets": [name.alias("tweet"), F.concat((d % 3).cast("string"), F.lit(".0")).alias("label")],
        "tweet_eval_binary": [name.alias("text"), (d % 3).alias("label")],
        "paradetox_pairs": [F.when(d % 2 == 0, name).otherwise(F.lit("")).alias("en_toxic_comment"), F.lit("neutral").alias("en_neutral_comment")],
    }
    root, left = staging.scratch(spark, "corpora"), dict(made)
    for spec in reversed(corpora.SPECS):  # one corpus of each kind is there, in the last of its splits
        if columns := left.pop(spec.kind, None):
            sinks.json_lines(l.select(*columns), f"{root}/{spec.folder}/{spec.splits[-1]}")
    return corpora.toxic_texts(spark, root).select("rank", "source", "text", F.round("score", 4).alias("score"))


def labelled_texts(spark, sf_dir):
    """The bag of two corpora of whole texts: of CSV files, and of a table."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("msg_content"))
    few = labels.count() <= BROADCAST_LABELS
    rows = docs.join(F.broadcast(labels) if few else labels, "doc_id").select("msg_content", "label")
    rows = rows if few else staging.staged(rows)  # both corpora read it
    path = _written(spark, "csv", lambda p: sinks.csv(rows, p))
    both = scans.corpora(scans.labelled(scans.csv(spark, path, "msg_content string, label string"), "msg_content", "label"), scans.labelled(rows, "msg_content", "label"))
    return both.select(F.md5(F.col("text").cast("binary")).alias("text"), F.length("text").alias("n"))


def literal_messages(spark, sf_dir):
    return scans.literal_messages(spark)


def mined_file(spark, sf_dir):
    """A capped file of mined contexts, written and scanned."""
    rows = mining.contexts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), per_source=3, most=25)
    path = _written(spark, "mined", lambda p: sinks.mined_file(rows).write.text(p))
    return scans.mined(spark.read.text(path), most=20).select("pos", "source", "toxicity_score", F.array_join("profane_terms", ",").alias("terms"), F.md5(F.col("context").cast("binary")).alias("context_md5"))


def mined_items(spark, sf_dir):
    """Normalised terms and contexts of mined rows, as rows of a vector table by stable ids."""
    rows = mining.contexts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    one = rows.select(F.explode("profane_terms").alias("term")).select(X.term(F.col("term")).alias("text"), F.lit("live_trained_profanity").alias("category")).where(F.length("text") >= 4)
    two = rows.select(F.substring(X.squeezed(F.col("context")), 1, 512).alias("text"), F.lit("mined_toxicity_context").alias("category")).where(F.length("text") >= 16)
    both = one.unionByName(two).distinct()
    return both.select("category", hashing.uuid_of("mined", F.col("text")).alias("id"), F.length("text").alias("n"))


def jsonl_triplets(spark, sf_dir):
    """Triplets of conversations of a language (or none), as JSON lines and back."""
    turns = read(spark, sf_dir, "conversations").withColumn("language", F.element_at(F.array(F.lit("en-GB"), F.lit("de"), F.lit("")), (F.col("conv_id") % 3 + 1).cast("int")))
    rows = mining.triplets(mining.in_language(turns, " EN"), lambda c: F.array_contains(X.letter_words(c), "la") | F.array_contains(X.letter_words(c), "die"))
    path = _written(spark, "triplets", lambda p: sinks.json_lines(rows, p))
    back = spark.read.schema(rows.schema).json(path)
    return back.select("conv_id", "turn", F.md5(F.col("anchor").cast("binary")).alias("anchor"), F.length("previous_clean_user").alias("clean_len"))


def toxic_triplets(spark, sf_dir):
    """Triplets by the terms of a turn; insults, their stems and toxic phrases are put into some turns."""
    said = F.element_at(F.array(F.lit(" you idiot and scum"), F.lit(" so trashy"), F.lit(" now get lost"), F.lit(""), F.lit(" indeed")), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 60), said).alias("text"))
    rows = mining.triplets(turns)
    return rows.select("conv_id", "turn", F.array_join("anchor_terms", ",").alias("terms"), F.md5(F.col("negative_assistant").cast("binary")).alias("answer"), F.md5(F.col("previous_clean_user").cast("binary")).alias("clean_user"))


def conversation_shapes(spark, sf_dir):
    """Conversations as JSON of several shapes: lists, containers, JSON texts within JSON, texts in parts."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("conv_id") % 4
    part = F.to_json(F.struct(F.col("role").alias("from"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")))
    plain = F.to_json(F.struct(F.concat(F.lit("The "), F.col("role")).alias("role"), F.col("text").alias("value")))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", F.when(F.col("conv_id") % 4 == 3, part).otherwise(plain).alias("m")))), lambda m: m["m"])
    rows = c.groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(lists, ","), F.lit("]")).alias("list"))
    value = F.when(k == 0, F.col("list")).when(k == 1, F.concat(F.lit('{"turns": {"messages": '), "list", F.lit("}}"))).when(k == 2, F.to_json(F.struct(F.col("list").alias("conversation_a")))).otherwise(F.concat(F.lit('{"chat": '), "list", F.lit("}")))
    got = scans.conversation(rows.select("conv_id", value.alias("value")))
    return got.select("conv_id", "turn", mining.speaker(F.col("role")).alias("speaker"), F.md5(F.col("text").cast("binary")).alias("text"))


def seed_words(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word"))
    return vector.bootstrapped(words).select(F.col("id").cast("string").alias("id"), "text", "category")


def vector_table(spark, sf_dir):
    """A table made with its placeholder, not made again, added to, upserted, and replaced."""
    embed = vector.hashed_ngrams(8)
    path = staging.scratch(spark, "vectors")
    sinks.create_if_missing(vector.placeholder(spark, 8), f"{path}/table")
    sinks.create_if_missing(vector.placeholder(spark, 8).limit(0), f"{path}/table")
    sinks.append(vector.trained(read(spark, sf_dir, "nation").select(F.lower("n_name").alias("text")), embed), f"{path}/table")
    again = vector.trained(read(spark, sf_dir, "region").select(F.lower("r_name").alias("text")).unionByName(read(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.lower("n_name").alias("text"))), embed)
    both = vector.upserted(spark.read.parquet(f"{path}/table").withColumn("version", F.lit(1)), again.withColumn("category", F.lit("seed_profanity")).withColumn("version", F.lit(2)))
    sinks.replace(both, f"{path}/replaced")
    out = spark.read.parquet(f"{path}/replaced")
    return out.select(F.col("id").cast("string").alias("id"), "text", "category", "version", F.size("vector").alias("dims"))


def text_vectors(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", vector.hashed_ngrams(16)(F.col("c_name")).alias("v"))
    return rows.select("c_custkey", F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), ",").alias("v"))


def text_forms(spark, sf_dir):
    """Terms, squeezed texts, first sentences, dates as numbers."""
    p = read(spark, sf_dir, "pages").select("page_id", X.term(F.col("url")).alias("term"), F.md5(X.squeezed(F.regexp_replace("html", "[\\n\\t]", "  ")).cast("binary")).alias("squeezed"))
    c = read(spark, sf_dir, "conversations").where("turn = 0").groupBy("conv_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    o = read(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), X.date_int(F.col("o_orderdate")).alias("n"), F.lit("").alias("form"))
    return o.unionByName(c.select(F.lit("sentence").alias("kind"), F.col("conv_id").alias("id"), X.first_sentence_length(F.col("text")).alias("n"), F.lit("").alias("form"))).unionByName(p.select(F.lit("page"), F.col("page_id"), F.length("term"), F.concat_ws(" ", "term", "squeezed")).toDF("kind", "id", "n", "form"))


def safe_casts(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.element_at(F.array(F.col("value").cast("string"), F.col("event_type"), F.lit("12.75"), F.lit(None).cast("string"), F.lit("")), (F.col("event_id") % 5 + 1).cast("int")).alias("t"))
    number = hashing.to_float(F.col("t"))
    return e.select("event_id", F.round(number, 6).alias("number"), hashing.to_int(F.col("t")).alias("whole"), F.round(hashing.clamped(number, 0.0, 10.0), 6).alias("clamped"))


def bloom_known_words(spark, sf_dir):
    """Words of conversations that a Bloom filter of the benchmark's words lets through."""
    words = lambda name: read(spark, sf_dir, name).select(F.explode(X.letter_words(F.coalesce("text", F.lit("")))).alias("word"))
    return lexical.maybe_known(words("conversations"), lexical.bloom(words("benchmark").distinct()))


def frequent_phrases(spark, sf_dir):
    """Contextual phrases of the lines of documents, by the words that stand in at least five documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = docs.select("doc_id", F.explode(F.array_distinct(X.letter_words(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return mining.phrases(docs.select(F.explode(F.split("text", "[.,\n]")).alias("text")), known)


def vector_probes(spark, sf_dir):
    """The words of unresolved messages that are compared by vector."""
    docs = staging.spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cascade.probed(docs).select("doc_id", F.posexplode("probes").alias("pos", "probe"))


def repeated_texts(spark, sf_dir):
    """Verdicts of turns, in which the same texts come again."""
    c = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat(F.element_at(F.array(F.lit("you idiot"), F.lit("2024-01-02"), F.lit("just die")), (F.col("turn") % 3 + 1).cast("int"))).alias("text"))
    return cascade.verdicts_once(c).select("doc_id", "verdict", "reason", "decision", "score")


def message_stream(spark, sf_dir):
    """Messages as they come, with training commands among them; what is judged is what the batch plan says."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("/train "), "text")).otherwise(F.col("text")).alias("text"))
    path = _written(spark, "messages", lambda p: docs.repartition(3).write.parquet(p))
    stream = scans.message_stream(spark, path, "doc_id long, text string", files_a_batch=1)
    plain, _ = scans.commands(stream)
    out = staging.scratch(spark, "verdicts")
    jobs.moderate(plain, cascade.verdicts, out, staging.scratch(spark, "state")).awaitTermination()
    return spark.read.parquet(out).groupBy("verdict", "reason").agg(F.count(F.lit(1)).alias("n"))


def training_commands(spark, sf_dir):
    docs = read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("/train  "), F.col("c_name"), F.lit("  "))).when(F.col("c_custkey") % 5 == 0, F.lit("/train   ")).otherwise(F.col("c_name")).alias("text"))
    plain, train = scans.commands(docs)
    return plain.select(F.lit("plain").alias("kind"), "text").unionByName(train.select(F.lit("train").alias("kind"), "text"))


def live_training(spark, sf_dir):
    """What one batch learns is known to the next: the same messages come before and after a training command."""
    embed = vector.hashed_ngrams()
    path = staging.scratch(spark, "live")
    for i, rows in enumerate([[(1, "x.blorple"), (2, "hello there")], [(3, "/train xblorple")], [(4, "x.blorple"), (5, "hello there")]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/in/{i}")
    store = lambda rows: rows.select(F.xxhash64("text").alias("id"), "vector", "category")
    sinks.replace(store(vector.trained(spark.createDataFrame([("zzzzzz",)], "text string"), embed)), f"{path}/table/learned=start")
    judge = lambda plain, table: cascade.semantic_verdicts(plain, embed, table, profanity=0.787)
    for i in range(3):  # one folder after the other, as files of one second have no order
        stream = scans.message_stream(spark, f"{path}/in/{i}", "doc_id long, text string")
        jobs.moderate_and_learn(stream, judge, lambda c, i=i: store(vector.trained(c, embed)).withColumn("turn", F.lit(i)), f"{path}/table", f"{path}/out/part={i}", f"{path}/state{i}").awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(f"{path}/out").select("doc_id", "verdict", "reason")


def violation_counters(spark, sf_dir):
    from modwarden.queries import event_stream

    return jobs.counted(event_stream(spark, sf_dir))


def platform_totals(spark, sf_dir):
    return reports.platforms(read(spark, sf_dir, "events"))


def pipe_fields(spark, sf_dir):
    """The third field of pipe-delimited lines by frequency, under headings with the first ten brands."""
    p = read(spark, sf_dir, "part").select(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", "p_brand", "p_type").alias("value"))
    third = scans.piped(p, 2).groupBy("field").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "field").limit(10)
    region = read(spark, sf_dir, "region").select("r_name")
    return sinks.report([("brands", third.select("field")), ("regions", region)])


SOURCE_QUERIES = {
    f.__name__: f
    for f in (
        word_file_scan, whitelist_scan, context_phrase_scan, moderation_db_words, scanned_lexicon, legacy_words, decision_overlay, labelled_corpora, labelled_texts, literal_messages, mined_file, mined_items,
        jsonl_triplets, toxic_triplets, conversation_shapes, seed_words, vector_table, text_vectors, text_forms, safe_casts, bloom_known_words, frequent_phrases, vector_probes, repeated_texts, message_stream, training_commands,
        live_training, violation_counters, platform_totals, pipe_fields,
    )
}
