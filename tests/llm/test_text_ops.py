"""Token counts, SentencePiece, licence scan and quality rules beside plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from modwarden.llm import license_scan, quality_cascade, sentencepiece_lattice, token_counts
from modwarden.llm.queries import tokenizer_path

ODD = ["", None, " ", "a" * 5000, "  x", "x  ", "<|endoftext|> a<|endoftext|>", "don't we'll I'm", "\r\n\t \u0085　é梦1٣½\x1c", "☃ ☃  ☃", "a▁b", "the the the " * 30, "MIT License mit license", "x" * 200_000]
#: A row of every kind of trouble, for operators that judge rows by themselves.
LONG = "x" * 1_000_000


def random_texts(n, alphabet, seed):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 70))) for _ in range(n)]


def table(spark, texts):
    """Documents with repeated rows, a null id and a column whose name an operator also uses."""
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2] + [(None, "null id", "clash")], "doc_id long, text string, n_tokens string")


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    texts = ODD + random_texts(3000, "ab  \n\t'sdre \x1c\x85　é梦1٣½,!\r​<|endoftext|>", 1)
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert token_counts.Counter(path).count([t or "" for t in texts]) == want
    got = token_counts.count_tokens(table(spark, texts[:40]), path).collect()
    assert len(got) == 43 and all(r.n_tokens == want[r.doc_id] and r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (want[r.doc_id] > 512) for r in got if r.doc_id is not None)
    assert token_counts.count_tokens(table(spark, []).limit(0), path).count() == 0


def test_token_cache_bound(monkeypatch):
    path = tokenizer_path("byte_bpe_50k.json")
    texts = random_texts(300, "abcdefgh  ", 2)
    want = token_counts.Counter(path).count(texts)
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 50)
    monkeypatch.setattr(token_counts, "CHUNK_PIECES", 20)
    assert token_counts.Counter(path).count(texts) == want


def test_token_counters_end_with_their_task(spark):
    docs = spark.range(4000, numPartitions=8).select(F.concat_ws(" ", *[F.hash("id", F.lit(k)).cast("string") for k in range(20)]).alias("text"))
    docs.select(token_counts.n_tokens(F.col("text"), tokenizer_path("byte_bpe_50k.json"))).write.format("noop").mode("overwrite").save()

    @F.udf("int")
    def alive(_):
        import gc

        return sum(type(o) is token_counts.Counter for o in gc.get_objects())

    assert {r[0] for r in spark.range(200, numPartitions=8).select(alive("id")).collect()} == {0}


def test_sentencepiece(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model, lib = sentencepiece_lattice.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for t in ODD] + random_texts(3000, "aabbeeinthrs    \n\t▁<0x>s/é梦☃1٣½,!\r​_", 3) + ["".join(random.Random(i).choice(model.text[300:3000]) for _ in range(25)).replace("▁", " ") for i in range(500)] + [" " * n for n in range(60)]
    want = lib.encode(texts)
    got = model.encode(texts)
    assert [g.tolist() for g in got] == want
    assert [model.decode(g) for g in got] == lib.decode(want)
    rows = sentencepiece_lattice.encoded(table(spark, texts[:60]), path).collect()
    assert len(rows) == 63 and all(list(r.ids) == want[r.doc_id] and r.n_ids == len(r.ids) and r.round_trip == ("▁" not in texts[r.doc_id]) for r in rows if r.doc_id is not None)


def test_sentencepiece_long_words(spark):
    """Words that are searched in windows, some of which agree with their run-up and some of which do not."""
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model, lib = sentencepiece_lattice.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(11)
    texts = ["x" * 100_000, "abcdefghijk" * 4000, "".join(r.choice("abcdeéßж01+/") for _ in range(60_000)), "".join(r.choice(["the", "ing", "tion", "ab", "e"]) for _ in range(25_000)) + " end", "=" * 45_001, "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(21_000))]
    assert [g.tolist() for g in model.encode(texts)] == [lib.encode(t) for t in texts]
    docs = spark.createDataFrame([(1, "y" * 10_000_000, "c"), (2, "a b", "c")], "doc_id long, text string, ids string")
    rows = {x.doc_id: x for x in sentencepiece_lattice.encoded(docs, path).select("doc_id", "n_ids", "round_trip").collect()}
    assert rows[1].n_ids == len(lib.encode("y" * 10_000_000)) and rows[1].round_trip and rows[2].n_ids == 2
    assert sentencepiece_lattice.encoded(docs.limit(0), path).count() == 0


def test_sentencepiece_unigram(tmp_path, monkeypatch):
    """The same pieces as a unigram model: the kind of model is one byte of the file."""
    import sentencepiece

    raw = open(tokenizer_path("piece_bpe_32k.model"), "rb").read()
    at = [m.start() for m in re.finditer(b"\x18\x02\x20", raw)]
    flipped = None
    for i in at:
        trial = raw[:i] + b"\x18\x01" + raw[i + 2 :]
        p = tmp_path / "m.model"
        p.write_bytes(trial)
        try:
            if sentencepiece_lattice.Pieces(str(p)).model == sentencepiece_lattice.UNIGRAM:
                flipped = str(p)
                break
        except Exception:
            continue
    if flipped is None:
        pytest.skip("the model's kind was not found in the file")
    model = sentencepiece_lattice.Pieces(flipped)
    for text in ("hello world", "the cat sat on the mat", "international business"):
        ids = model.encode([text])[0]
        assert model.decode(ids) == text

        def best(word):
            known = {t: model.score[i] for i, t in enumerate(model.text) if model.kind[i] == sentencepiece_lattice.NORMAL}
            top = [0.0] + [float("-inf")] * len(word)
            for j in range(1, len(word) + 1):
                top[j] = max([top[i] + known[word[i:j]] for i in range(max(0, j - 16), j) if word[i:j] in known and top[i] > float("-inf")] + [float("-inf")])
            return top[-1]

        assert model.score[ids].sum() == pytest.approx(sum(best("▁" + w) for w in text.split(" ")))
    long = "".join(random.Random(3).choice(["the", "cat", "sat", "x"]) for _ in range(200))
    want = model.encode([long])[0]
    for name, n in (("LONG", 90), ("WINDOW", 60), ("RUN_UP", 40)):
        monkeypatch.setattr(sentencepiece_lattice, name, n)
    again = sentencepiece_lattice.Pieces(flipped).encode([long])[0]
    assert model.score[again].sum() == pytest.approx(model.score[want].sum()) and model.decode(again) == long


def plain_scan(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    norm = f" {' '.join(words)} " if words else ""
    found = []
    for r in license_scan.rules():
        if r.keyword in words and (not r.anchor or r.anchor in words):
            found += [(m.start(), -m.end(), -r.priority, r.rank, r.label, r.weight) for m in re.finditer(r.regex, norm)]
    kept = []
    for d in sorted(found):
        inside = [e for e in found if e != d and e[0] <= d[0] and -e[1] >= -d[1] and -e[2] >= -d[2] and sorted((e, d))[0] == e]
        if not inside:
            kept.append(d)
    score = max([d[5] for d in kept] + ([0.6] if places else [0.0]))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {d[4] for d in kept})), score


def test_license_scan(spark):
    texts = ODD + [
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3 or later", "GNU Lesser General Public License v2.1 or GPL",
        "SPDX-License-Identifier: GPL-2.0-only\nMIT LICENSE", "Licensed under CC BY-NC 4.0.", "der mit lizenz", "MIT licenses Apache License", "é mit license mit license", "public domain; licensed under the BSD 3-Clause license", "K mit license", "BSD License " * 50,
    ]
    names = [f[2] for f in license_scan.FAMILIES]
    r = random.Random(4)
    texts += [" ".join(r.choice(["released under the", "mit", "license", "apache", "2 0", "gnu", "general public license", "spdx license identifier", "gpl", "x", "cc by nc", "lesser"]) for _ in range(r.randint(1, 14))) for _ in range(150)]
    assert len(license_scan.rules()) >= 200 and all(re.compile(n) for n in names)
    rows = license_scan.scanned(table(spark, texts)).collect()
    assert len(rows) == len(texts) + 3 and [x.n_words for x in rows if x.doc_id is None] == [2]
    for x in rows:
        if x.doc_id is not None:
            assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels, x.score) == plain_scan(texts[x.doc_id]), texts[x.doc_id]
    assert license_scan.scanned(table(spark, texts).limit(0)).count() == 0


def matches_of(regex):
    """Every string that a regex without repetition matches, look-arounds aside."""
    from re import _parser

    def of(items):
        out = [""]
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                some = [chr(arg)]
            elif op == "IN":
                assert all(str(o) == "LITERAL" for o, _ in arg)
                some = [chr(v) for _, v in arg]
            elif op == "SUBPATTERN":
                some = of(arg[3])
            elif op == "BRANCH":
                some = [x for branch in arg[1] for x in of(branch)]
            elif op == "MAX_REPEAT":
                assert (arg[0], int(arg[1])) == (0, 1)
                some = ["", *of(arg[2])]
            else:
                assert op == "ASSERT"
                some = [""]
            out = [a + b for a in out for b in some]
        return out

    return of(_parser.parse(regex))


def test_license_rules_hold_their_words():
    for r in license_scan.rules():
        # what stands for a name holds none of a rule's words
        for m in matches_of(r.regex.replace(license_scan._NAME, "name ").replace("[0-9 ]{1,5}", "3 0")):
            assert r.keyword in m.split(" ") and (not r.anchor or r.anchor in m.split(" ")), (r, m)


def test_license_labels_without_the_gate(spark):
    texts = ["MIT No Attribution License", "MIT No Attribution", "released under the PSF license", "PSF licence", "under GPL2", "GPLv2 0", "GPL3 0", "License: GPL3", "Licence: MIT 0", "the licence is the Boost Software Licence", "SPDX-License-Identifier: MIT-0", "Licence: GPL v2 0", "x gpl2 license", "Licence: Apache Licence 2.0", "released under the MIT No Attribution License", "covered by the PSF License", "this is gpl2 code"]
    want = []
    for t in texts:
        norm = f" {' '.join(re.findall('[a-z0-9]+', t.lower()))} "
        found = [(m.start(), m.end(), r.priority, r.label, r.weight) for r in license_scan.rules() for m in re.finditer(r.regex, norm)]
        kept = [d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and e[:2] != d[:2] for e in found)]
        kept = [d for d in kept if not any(e[:2] == d[:2] and e[2] > d[2] for e in kept)]
        want.append(({d[3] for d in kept}, max(d[4] for d in kept)))
    got = {r.doc_id: (set(r.labels.split(",")), r.score) for r in license_scan.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    base = {i: {label for p, label in license_scan.BASE if f" {p} " in f" {' '.join(re.findall('[a-z0-9]+', t.lower()))} "} for i, t in enumerate(texts)}
    assert [got[i] for i in range(len(texts))] == [(w | base[i], s) for i, (w, s) in enumerate(want)]
    assert [got[i][0] for i in (0, 2, 4, 7)] == [{"mit-0"}, {"python-2.0"}, {"gpl-2.0"}, {"gpl-3.0"}] and got[8] == ({"mit-0"}, 0.8)
    assert [got[i] for i in (13, 14, 15, 16)] == [({"apache-2.0"}, 0.8), ({"mit-0"}, 0.9), ({"python-2.0"}, 0.7), ({"gpl-2.0"}, 0.7)]


def test_license_every_rule_is_found_through_the_gate(spark):
    """A text made of each rule's shortest and longest match has, through the gate, a detection there of its priority or more."""
    texts, rules = [], license_scan.rules()
    for r in rules:
        some = matches_of(r.regex.replace(license_scan._NAME, "some one ").replace("[0-9 ]{1,5}", "3 0"))
        texts += [(len(texts), "Zz " + min(some, key=len) + " zz", r), (len(texts) + 1, "Zz " + max(some, key=len) + " zz", r)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    got = {x.doc_id: x for x in license_scan.scanned(docs).collect()}
    for i, t, r in texts:
        ends = (4, len(" ".join(re.findall("[a-z0-9]+", t.lower()))) + 1 - 3)
        assert any(d.start <= ends[0] and d.stop >= ends[1] and d.priority >= r.priority for d in got[i].detections), (t, r)


def test_license_sentences(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
    to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"""
    bsd = "Neither the name of the Great Holder Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"
    docs = spark.createDataFrame([(0, mit), (1, bsd), (2, gpl), (3, mit.replace("hereby", "not"))], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scanned(docs).collect()}
    assert got == {0: ("mit", 0.97), 1: ("bsd-3-clause", 0.97), 2: ("gpl,gpl-3.0", 0.97), 3: ("mit", 0.97)}


def test_quality(spark):
    fresh = lambda n, k=0: " ".join(f"word{chr(97 + i % 26)}{chr(97 + (i // 26 + k) % 26)}" for i in range(n))
    clean = fresh(80)
    lines = "\n".join(["a line of it"] * 3 + [f"{chr(97 + i)}x{i} {chr(98 + i)}y{i} {chr(99 + i)}z{i} {chr(97 + i)}w{i}" for i in range(20)])
    texts = {1: clean, 2: "short", 3: "same words here " * 40, 4: " ".join(f"w{i}###" for i in range(60)), 5: lines, 6: clean.upper(), 7: None, 8: "", 9: " | ".join(clean.split()), 10: clean.replace(" ", "!! "), 11: " ".join(f"t{i}o{i * 7}" for i in range(300_000))}
    docs = spark.createDataFrame([*((i, t, i) for i, t in texts.items()), (1, clean, 1), (None, clean, 2), (None, None, 3)], "doc_id long, text string, kept long")
    rows = quality_cascade.report(docs).collect()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 14 and sorted(r.doc_id for r in rows if r.kept and r.doc_id is not None) == [1, 1, 5, 11]
    assert sorted((r.n_words, r.kept) for r in rows if r.doc_id is None) == [(0, False), (80, True)]
    assert got[3].base_failed and got[3].n_repeat_words == 120 and got[5].n_dup_lines == 2 and got[4].n_symbols == 180 and got[11].n_words == 300_000
    left = quality_cascade.kept(docs)
    assert sorted((r.doc_id or 0, r.kept) for r in left.collect()) == [(0, 2), (1, 1), (1, 1), (5, 5), (11, 11)] and left.columns == docs.columns
    assert quality_cascade.report(docs.limit(0)).count() == quality_cascade.kept(docs.limit(0)).count() == 0


def test_shouting_in_other_scripts(spark):
    r = random.Random(8)
    word = lambda first, n: "".join(chr(first + r.randrange(n)) for _ in range(6))
    texts = [" ".join(word(first, n) for _ in range(80)) + " NATO USB" for first, n in ((0x430, 32), (0x3B1, 17), (0x621, 26))]
    texts += [" ".join(word(65, 26) for _ in range(80)), " ".join(word(65, 26) for _ in range(80)) + " " + word(0x430, 32)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in quality_cascade.kept(docs).collect()) == [0, 1, 2]
    assert sorted(x.doc_id for x in quality_cascade.report(docs).where("kept").collect()) == [0, 1, 2]


def test_quality_features():
    r = random.Random(6)
    for _ in range(300):
        t = "".join(r.choice("ab \n\t#*") for _ in range(r.randint(0, 60)))
        f = quality_cascade.Features(t)
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        cover = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (f.n_words, f.word_chars, f.n_repeat_words, f.n_dup_lines) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))


def test_rule_order():
    rules = quality_cascade.RULES[:3]
    order = quality_cascade.ordered(rules, [(rules[0].name, 1.0, 1.0), (rules[1].name, 0.1, 1.0), (rules[2].name, 5.0, 0.0)])
    assert [r.name for r in order] == [rules[1].name, rules[0].name, rules[2].name]


def test_decoded_column(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    rows = sentencepiece_lattice.decoded(sentencepiece_lattice.encoded(docs, path).withColumn("ids", F.when(F.col("doc_id") == 1, F.col("ids"))), path).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, "a text"), (2, None)]
