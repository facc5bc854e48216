"""Text functions beside plain Python that says what they mean."""

import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modwarden.functions import signals
from modwarden.functions import text as X
from modwarden.operators import candidates

ODD = ["n###xxx", "i d i o t", "Mooorie", "hello,", "2024", "a2024", "h e l l o", "kill yourself!", "just die", "ｉｄｉｏｔ", "ﬁne", "é", "", " ", "a\tb\nc", "x​y", "$a$h", "01/02/2024", "it's", "well-known", "Hello", "AAA-111", "sin(x)", "1+2=3", "@abcd", "12345"]


def plain_normalized(t):
    s = unicodedata.normalize("NFKC", t).lower()
    if re.search(r"[a-z@$!|+]", s):
        s = s.translate(str.maketrans("4310578269", "aeiostbzgg"))
    s = s.translate(str.maketrans("@$!|+", "asiit"))
    return re.sub("[^a-z0-9]+", " ", s).strip(" ")


def test_normalisation(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", X.nfkc(F.col("t")).alias("n"))
    for r in rows.select("t", X.normalized(F.col("n")).alias("x"), X.collapsed(X.compact(F.col("n"))).alias("k")).collect():
        assert r.x == plain_normalized(r.t), r
        assert r.k == re.sub(r"(.)\1+", r"\1", plain_normalized(r.t).replace(" ", "")), r


def test_null_text(spark):
    rows = spark.createDataFrame([(None,), ("",)], "t string")
    assert [tuple(r) for r in rows.select(X.nfkc(F.col("t")), X.normalized(F.col("t")), F.size(X.chunks(F.coalesce("t", F.lit(""))))).collect()] == [(None, None, 0), ("", "", 0)]


def test_surface(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string")
    got = {r.t: r for r in rows.select("t", *[c.alias(k) for k, c in signals.surface(F.col("t")).items()]).collect()}
    assert got["Hello"].alpha_only and not got["a\tb\nc"].alpha_only
    assert got["x​y"].hard_separator and got["$a$h"].hard_separator and got["$a$h"].leet
    assert got["well-known"].hyphen_only and not got["AAA-111"].hyphen_only
    assert got["it's"].apostrophe and got["01/02/2024"].digit and not got["01/02/2024"].hard_separator


def test_risk_and_guards(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string")
    t = F.col("t")
    got = {r.t: r for r in rows.select("t", signals.high_risk_phrase(t).alias("h"), signals.date_like(t).alias("d"), signals.code_like(t).alias("c"), signals.math_like(t).alias("m"), signals.link(t).alias("l"), signals.numeric_noise(t).alias("n")).collect()}
    assert got["just die"].h and not got["kill yourself!"].h
    assert got["01/02/2024"].d and not got["2024"].d
    assert got["AAA-111"].c and got["sin(x)"].m and got["1+2=3"].m and got["@abcd"].l and got["12345"].n


def test_candidate_traps():
    strict, collapsed, merged = candidates.extracted("n###xxx")
    assert strict["nxxx"] and merged["nxxx"]
    assert candidates.extracted("i d i o t")[0]["idiot"]
    assert candidates.extracted("mooorie")[0]["moory"]
    assert candidates.extracted("hello,")[0] == {"hello": True}
    assert candidates.extracted("hello hello")[0] == {"hello": False}
    assert candidates.extracted("2024")[0] == {"2024": True}
    assert candidates.extracted(None) == ({}, {}, {})
    assert len(candidates.extracted(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}o" for i in range(400)))[2]) == 128


def test_candidates_of_composed_texts(spark):
    rows = candidates.with_candidates(spark.createDataFrame([(0, "ｉｄｉｏｔ  ﬁne"), (1, None), (2, ""), (3, " ".join(f"w{i}x" for i in range(20_000)))], "i int, t string"), "t")
    got = {r.i: r for r in rows.collect()}
    assert got[0].composed == "idiot  fine" and [c.text for c in got[0].candidates] == ["idiot", "fine"] and got[1].composed is None and got[1].candidates == got[2].candidates == []
    assert sum(c.strict is not None for c in got[3].candidates) == sum(c.merged is not None for c in got[3].candidates) == 128
    assert len(candidates.looked_at("x")) == 2


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abiexz  .@3é", max_size=60))
def test_candidates_hold_only_words(t):
    for s in candidates.extracted(t):
        assert len(s) <= 128 and all(re.fullmatch("[a-z0-9]{2,24}", w) for w in s)


def test_label_state(spark):
    rows = spark.createDataFrame([(x,) for x in ("toxic", "Non-toxic", "0", "1", "maybe", None)], "l string")
    assert [r[0] for r in rows.select(signals.label_state(F.col("l"))).collect()] == [True, False, False, True, None, None]
