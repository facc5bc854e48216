"""Operators on small tables."""

import random
import time

from pyspark.sql import functions as F

from modwarden import lexicon
from modwarden.functions import distance, hashing
from modwarden.operators import candidates, containment, lexical, seeds, vector
from modwarden.plans import cascade, mining, reports
from modwarden.sources import scans, sinks
from modwarden.streaming import jobs


def aligned(a, b):
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            new.append(best)
        older, old = old, new
    return old[-1]


def test_osa(spark):
    r = random.Random(5)
    pairs = [("".join(r.choice("abc") for _ in range(r.randint(1, 6))), "".join(r.choice("abc") for _ in range(r.randint(1, 6)))) for _ in range(400)] + [("ca", "abc"), ("abcd", "abdc"), ("", "ab"), ("ab", ""), ("", "")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    for x in rows.select("a", "b", distance.osa(F.col("a"), F.col("b")).alias("d"), distance.within_one(F.col("a"), F.col("b")).alias("one"), distance.may_be_within(F.col("a"), F.col("b"), 2).alias("may")).collect():
        assert x.d == aligned(x.a, x.b) and x.one == (x.d <= 1), x
        assert x.may or x.d > 2, x
    assert aligned("ca", "abc") == 3
    assert spark.createDataFrame([(None, "a")], "a string, b string").select(distance.osa(F.col("a"), F.col("b"))).first()[0] is None


def test_hashes(spark):
    row = spark.createDataFrame([("abc",), ("",)], "t string").select(hashing.fnv1a32(F.col("t")).alias("a"), hashing.fnv1a64(F.col("t")).cast("string").alias("b"), hashing.djb2(F.col("t")).alias("c")).collect()
    assert (row[0].a, row[0].b) == (440920331, "16654208175385433931") and row[1].a == 2166136261 and row[1].c == 5381


def test_cascade(spark):
    texts = {1: "just end yourself finally", 2: "hello friendly world", 3: "you IDIOT", 4: "i.d.i.o.t", 5: "the", 6: "clown", 7: "ids closer", 8: None, 9: "whh", 10: "idi0t", 11: "just die", 12: "2024-01-02", 13: "t r a s h talk", 14: "stupld!", 15: "that"}
    got = {r.doc_id: r for r in cascade.verdicts(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert len(got) == len(texts)
    assert got[1].verdict == got[3].verdict == got[11].verdict == got[9].verdict == "block"
    assert got[13].verdict == "block" and got[13].reason == "lexical_match"
    assert got[2].verdict == got[8].verdict == got[12].verdict == "allow" and got[2].reason == "no_lexical_or_semantic_hit"
    assert got[6].reason == "lexical_skip" and got[6].verdict == "allow"  # whitelisted and bad: the whitelist wins
    assert got[15].reason == "lexical_skip"


def test_semantic_stages(spark):
    texts = {1: "x.disgusting", 2: "hello friendly world", 3: "you IDIOT", 4: "i would say xdisgusting to all of you here and now", 5: "xdisgusting", 6: "clown", 7: None, 8: "q0zzlement", 9: "x_disgusting and y_pathetic", 10: "x.disgusting"}
    docs = spark.createDataFrame([*texts.items(), (None, "x.disgusting")], "doc_id long, text string")
    embed = vector.hashed_ngrams()
    seeds_ = vector.bootstrapped(lexicon.words(spark, lexicon.BAD_WORDS)).select(F.xxhash64("text").alias("id"), embed(F.col("text")).alias("vector"), "category")
    plain = {r.doc_id: r for r in cascade.verdicts(docs).collect()}
    got = {r.doc_id: r for r in cascade.semantic_verdicts(docs, embed, seeds_).collect()}
    assert set(got) == set(plain) and plain[1].verdict == "allow"
    for i in (1, 9, 10, None):
        assert (got[i].verdict, got[i].reason, got[i].needs_semantic) == ("block", "semantic_profanity", False), got[i]
    for i in (2, 3, 4, 6, 7, 8):
        assert got[i].reason != "semantic_profanity" and (got[i].needs_semantic or got[i] == plain[i]), got[i]
    # only profanity categories count for a word; the fallback searches all, and only what is unresolved
    other = cascade.semantic_verdicts(docs, embed, seeds_.withColumn("category", F.lit("general_scam"))).collect()
    assert all(r.reason != "semantic_profanity" for r in other)
    whole = spark.createDataFrame([(1, "send the wallet seed now")], "doc_id long, text string")
    index = whole.select(F.col("doc_id").alias("id"), embed(F.col("text")).alias("vector"), F.lit("general_scam").alias("category"))
    row = cascade.semantic_verdicts(whole, embed, index).first()
    assert cascade.verdicts(whole).first().needs_semantic and (row.verdict, row.reason) == ("block", "semantic_fallback")


def test_vector_candidates(spark):
    """P20 over candidates as extracted, beside its rules in plain words."""
    many = [f"word{chr(97 + i)}" for i in range(20)]
    cases = [
        ("abcd, abc, plain idiot, closer, this,", ["abcd"]),  # plain is not odd; the others are short or known
        ("plain1 2", ["plaini"]),
        (" ".join(f"{w}," for w in many[:9]), []),
        (" ".join(f"{w}," for w in many[:8]), many[:8]),
        (None, []),
    ]
    rows = candidates.with_candidates(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")).drop("text")
    t = F.coalesce("composed", F.lit(""))
    rows = rows.withColumns({"tokens": F.array().cast("array<string>"), "few": F.regexp_count(t, F.lit(r"\S+")) <= 8, "odd": t.rlike("[0-9]")}).drop("composed")
    got = lexical.evidence(rows, lexicon.project(spark)).select("i", "probes").collect()
    assert [x.probes for x in sorted(got)] == [c[1] for c in cases]


def test_scanned_lexicon_feeds_the_cascade(spark):
    raw = spark.createDataFrame([('{"entries":[{"match":"blorple|gnasher","severity":3},{"word":["qzx"],"tags":["acronym","hate"]}],"whitelist":["gnashed"],"slangMap":{}}',)], "value string")
    lex = lexicon.of_tables(scans.moderation_db(raw) | {"clean": lexicon.words(spark, ["hello", "there", "blorple"]), "trigger": lexicon.words(spark, ["hello"])}, ["hello there"])
    texts = {1: "you BLORPLE", 2: "you idiot", 3: "qzx", 4: "gnashed", 5: "there", 6: "hello there", 7: "b.l.o.r.p.l.e", 8: "gnsher", 9: None}
    docs = spark.createDataFrame([*texts.items(), (1, "repeated id"), (None, "gnasher")], "doc_id long, text string")
    got = {(r.doc_id, r.reason): r.verdict for r in cascade.verdicts(docs, lex=lex).collect()}
    assert len(got) == 11 and got[(1, "lexical_match")] == got[(3, "lexical_match")] == got[(7, "lexical_match")] == got[(None, "lexical_match")] == "block"
    assert got[(2, "no_lexical_or_semantic_hit")] == got[(4, "lexical_skip")] == got[(5, "lexical_skip")] == "allow" and got[(6, "contextual_whitelist_phrase")] == "block"
    assert (8, "lexical_match") in got and (1, "no_lexical_or_semantic_hit") in got


def test_raw_hit_by_pattern_and_automaton(spark, monkeypatch):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["a THWHORER b", "trashcan", "nothing", "", None, "xidiot"])], "i int, t string")
    words = ["whore", "idiot", "trash"]
    one = [r.h for r in sorted(texts.select("i", lexical.raw_hit(F.col("t"), words).alias("h")).collect())]
    monkeypatch.setattr(lexical, "PATTERN_WORDS", 1)
    two = [r.h for r in sorted(texts.select("i", lexical.raw_hit(F.col("t"), words).alias("h")).collect())]
    assert [bool(x) for x in one] == two == [True, True, False, False, False, True]
    assert not texts.select(lexical.raw_hit(F.col("t"), []).alias("h")).where("h").count()


def test_top1(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(60)] + [(60, None)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {x.id: x.match for x in vector.top1(v, v, -1.0, skip_self=True, block_rows=7).collect()}

    def cos(a, b):
        return sum(p * q for p, q in zip(a, b)) / (sum(p * p for p in a) * sum(q * q for q in b)) ** 0.5

    for i, a in rows[:60]:
        assert got[i] == max((j for j in range(60) if j != i), key=lambda j: cos(a, rows[j][1]))
    assert 60 not in got


def test_upsert(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "id int, version int, x string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e")], "id int, version int, x string")
    assert sorted((r.id, r.x) for r in vector.upserted(old, new).collect()) == [(1, "c"), (2, "b"), (3, "e")]


def test_round_robin(spark):
    w = spark.createDataFrame([(x,) for x in ("apple", "apply", "bear", "cats", "1abc", "cat")], "word string")
    assert [r.word for r in seeds.round_robin(w, 10).collect()] == ["apple", "bear", "cats", "1abc", "apply"]


def test_moderation_db(spark):
    raw = spark.createDataFrame([('{"entries":[{"match":"Trash|scum","severity":3},{"word":["wtx","abcd"],"tags":["Acronym","hate"]},{"match":"mildword","severity":1}],"whitelist":["Okay"],"slangMap":{"smh":"x","dumbo":"y"}}',), ("broken",)], "value string")
    db = {k: sorted(r.word for r in v.collect()) for k, v in scans.moderation_db(raw).items()}
    assert db == {"bad": ["abcd", "dumbo", "scum", "trash"], "short": ["wtx"], "aggressive": ["wtx"], "whitelist": ["okay"]}


def test_legacy_and_fallback(spark):
    raw = spark.createDataFrame([("Trash", "EN", 3), ("scum", None, None), ("salaud", "fr", 4), ("meh", "en", 4), ("mildly", "en", 1)], "word string, lang string, severity int")
    one = scans.legacy(raw)
    assert sorted(r.word for r in one.collect()) == ["scum", "trash"]
    none = one.limit(0)
    assert [r.word for r in scans.bad_words(none, fallback=spark.createDataFrame([("pattern",)], "word string")).collect()] == ["pattern"]


def test_conversation_shapes(spark):
    raw = spark.createDataFrame([('{"messages":[{"role":"user","content":"hi"},{"from":"bot","value":"yo"}]}',), ('[{"speaker":"human","text":"a"}]',), ("{}",)], "value string")
    assert sorted((r.role, r.text) for r in scans.conversation(raw).collect()) == [("bot", "yo"), ("human", "a"), ("user", "hi")]


def test_phrases(spark):
    rows = spark.createDataFrame([("The end of this.",), ("these were the end",), ("end of nothing known",)], "text string")
    assert sorted(r.phrase for r in mining.phrases(rows, lexicon.words(spark, [*lexicon.WHITELIST, *lexicon.CLEAN_SET, *lexicon.TRIGGER_TOKENS])).collect()) == ["these were the end"]


def test_triplets(spark):
    turns = [(1, 0, "user", "a clean question here"), (1, 1, "assistant", "a clean answer here"), (1, 2, "user", "you are worthless scum"), (1, 3, "system", "note"), (1, 4, "assistant", "please stay polite"), (1, 5, "user", "stupid stupid thing"), (1, 6, "user", "another question")]
    got = [tuple(r)[:5] for r in mining.triplets(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()]
    assert got == [(1, 2, "you are worthless scum", "please stay polite", "a clean question here")]


def test_triplets_by_phrase(spark):
    turns = [(1, 0, "user", "a clean question here"), (1, 1, "user", "get lost now please"), (1, 2, "assistant", "please stay polite"), (1, 3, "user", "just shut up already"), (1, 4, "assistant", "an answer to it")]
    got = sorted(tuple(r)[:5] for r in mining.triplets(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect())
    assert got == [(1, 1, "get lost now please", "please stay polite", "a clean question here"), (1, 3, "just shut up already", "an answer to it", "a clean question here")]
    texts = spark.createDataFrame([(0, "get lost now the 12"), (1, "you idiot get lost"), (2, "nothing of it"), (3, "shut up")], "i int, t string")
    assert [r.v for r in sorted(texts.select("i", mining.turn_terms(F.col("t")).alias("v")).collect())] == [["get", "lost", "now"], ["idiot"], [], ["shut"]]


def test_toxic_asymmetry(spark):
    rows = spark.createDataFrame([(0.1, 0.9), (0.6, 0.0)], "toxic_score double, threat double")
    got = mining.toxic_scores(rows, ["toxic_score", "threat"], ["toxic_score"], 0.5).collect()
    assert [(r.score, r.toxic) for r in got] == [(0.9, False), (0.6, True)]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(i, f"2024-01-0{1 + i % 5} 10:00:00", i % 7, "error" if i % 3 else "view", 1.0) for i in range(50)], "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    assert sorted(map(tuple, jobs.drained(jobs.daily_counts(stream)).collect())) == sorted(map(tuple, reports.daily(e).collect()))


def test_moderate_stream(spark, tmp_path):
    m = spark.createDataFrame([(1, "you idiot"), (2, "hello there"), (3, None), (4, "/train some words")], "doc_id long, text string")
    m.write.parquet(str(tmp_path / "m"))
    stream = scans.message_stream(spark, str(tmp_path / "m"), "doc_id long, text string")
    plain, _ = scans.commands(stream)
    jobs.moderate(plain, cascade.verdicts, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted((r.doc_id, r.verdict) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "block"), (2, "allow")]


def test_containment(spark, monkeypatch):
    r = random.Random(3)
    words = ["the", "cat", "sat", "on", "mats", "ab", "x"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(60)] + [None, "", "the cat sat  on the mat", "one\nodd line"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 6)))[r.randint(0, 2) :]) for i in range(40)] + [(90, ""), (91, None), (92, "one\nodd"), (93, "at on the ma"), (94, "cat sat  on the m")]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, "the cat sat on the mats ab")], "doc_id int, text string")
    want = {(i, d) for i, p in items if p for d, t in [*enumerate(texts), (None, "the cat sat on the mats ab")] if t and p in t}
    for n in (1000, 3):
        monkeypatch.setattr(containment, "SHORT_PASSAGES", n)
        got = [tuple(x) for x in containment.passages_in(docs, spark.createDataFrame(items, "item_id int, passage string")).collect()]
        assert set(got) == want and len(got) == len(set(got))


def test_csv_keeps_texts(spark, tmp_path):
    texts = ["ends in a line\n", "\tbegins and ends in a tab\t", "\n", " ", "", "a\rb", "a\r\nb\r", 'say "no", or\nnot', '"', "back\\", "\\\"", "# none", "\0 first", "plain"]
    rows = spark.createDataFrame([(t, "1") for t in [*texts, None]], "text string, label string")
    sinks.csv(rows.coalesce(1), str(tmp_path / "csv"))
    back = scans.csv(spark, str(tmp_path / "csv"), "text string, label string")
    assert sorted(r.text for r in back.where("text is not null").collect()) == sorted(texts) and back.count() == len(texts) + 1
    assert sorted(r.text for r in scans.labelled(back, "text", "label").collect()) == sorted(t.strip(" ") for t in texts)


def test_containment_of_long_texts(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdef") for _ in range(5)) for _ in range(30_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:20_000]))], "doc_id int, text string")
    items = spark.createDataFrame([(7, " ".join(words[25_000:25_020])), (8, " ".join(words[5:9]))], "item_id int, passage string")
    began = time.time()
    got = sorted(tuple(x) for x in containment.passages_in(docs, items).collect())
    assert got == [(7, 1), (8, 1), (8, 2)]
    assert time.time() - began < 60  # the square of the words takes minutes
