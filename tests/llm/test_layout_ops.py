"""Chat formatting, sharding, packing and the pipeline."""

import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from modwarden.llm import chat_rotation, common, jump_shards, length_buckets
from modwarden.llm.shingles import mixed


def test_rotation(spark):
    turns = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (2, 0, "system", "alone"), (3, 0, None, "who"), (None, 0, "ann", "x"), (1, 3, "ann", None)]
    rows = chat_rotation.rotated(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), block_rows=3).collect()
    text = {}
    for r in sorted(rows, key=lambda r: r.seg_start):
        k = (r.conv_id, r.perspective)
        assert r.seg_start == len(text.get(k, "")) and r.seg_end == r.seg_start + len(r.segment)
        text[k] = text.get(k, "") + r.segment
    assert set(text) == {(1, "ann"), (1, "bob"), (3, "unknown"), (None, "ann")}
    assert text[(1, "bob")] == "<|turn|>system\nrules<|end|>\n<|turn|>user name=ann\nhi<|end|>\n<|turn|>assistant\nyo<|end|>\n" + "<|turn|>user name=ann\n<|end|>\n" * 2
    own = [r for r in rows if r.perspective == "bob" and r.learn_start is not None]
    assert len(own) == 1 and text[(1, "bob")][own[0].learn_start : own[0].learn_end] == "yo<|end|>\n"


def test_rotation_edges(spark):
    long = "x" * 2_000_000
    turns = spark.createDataFrame([(1, 0, "ann", long, "c"), (1, None, "bob", "first", "c"), (1, 0, "ann", long, "c")], "conv_id long, turn long, role string, text string, segment string")
    rows = [r for r in chat_rotation.rotated(turns).collect() if r.perspective == "bob"]
    assert [(r.turn, len(r.segment)) for r in sorted(rows, key=lambda r: r.seg_start)] == [(None, 31), (0, 2_000_030), (0, 2_000_030)] and sorted(r.seg_start for r in rows) == [0, 31, 2_000_061]
    assert chat_rotation.rotated(turns.limit(0)).count() == 0


def test_hot_keys_are_cut(spark):
    """10,000 equal rows with a null key, in one group, lie in blocks of bounded size and are numbered without gaps."""
    df = spark.range(10_000).select(F.lit("g").alias("g"), F.lit(None).cast("long").alias("k"), F.lit("t").alias("t"))
    seen = []
    real = common.staging.staged

    def spy(x, *a):
        out = real(x, *a)
        if "__block" in out.columns:
            seen.append([r["count"] for r in out.groupBy("__block").count().collect()])
        return out

    common.staging.staged = spy
    try:
        got = sorted(r.n for r in common.numbered(df, ["g"], "k", ["t"], "n", block_rows=1_000).collect())
    finally:
        common.staging.staged = real
    assert got == list(range(10_000)) and len(seen[0]) >= 8 and max(seen[0]) <= 2_000


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.array([0, 1, 2, 12345, 2**63, 2**64 - 1] + list(range(500)), dtype=np.uint64)
    for n in (1, 2, 24, 1000):
        assert jump_shards.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    a, b = jump_shards.jump(mixed(np.arange(20_000, dtype=np.uint64)), 24), jump_shards.jump(mixed(np.arange(20_000, dtype=np.uint64)), 25)
    assert np.all((a == b) | (b == 24)) and abs((b == 24).mean() - 1 / 25) < 0.01 and np.bincount(a).max() < 1.15 * 20_000 / 24


def test_shards(spark):
    r = random.Random(1)
    rows = [(r.randrange(10**6), "t" * r.randrange(9), "s") for _ in range(500)] + [(10**7, "é" * 1_500_000, "s")] + [(7, "é", "s"), (7, "é", "s"), (None, None, "s"), (None, "x", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = jump_shards.assigned(docs, 24).collect()
    assert len(got) == len(rows) and {x.law for x in got} == {"key"}
    for s in range(24):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))
    for x in got:
        key = int(mixed(np.array([x.doc_id or 0], dtype=np.uint64))[0])
        assert x.shard == plain_jump(key, 24) and x.grown_shard == plain_jump(key, 25)
    assert next(x.size for x in got if x.doc_id == 10**7) == 3_000_008
    one = next(x for x in got if x.doc_id == 7)
    assert (one.size, one.text_crc32) == (10, zlib.crc32("é".encode()))
    assert jump_shards.assigned(docs.limit(0), 24).count() == 0


def test_running_blocks(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.choice([None, *range(50)]), i, r.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, i long, v long")
    whole, cut = (sorted(map(tuple, common.running(df, ["g"], "k", ["i"], F.col("v"), "out", n).collect()), key=repr) for n in (10**6, 37))
    assert whole == cut
    slots = common.numbered(df, ["g"], "k", ["i"], "out", 37).collect()
    assert all(sorted(x.out for x in slots if x.g == g) == list(range(sum(y[0] == g for y in rows))) for g in "ab")


def test_best_bounds():
    r = random.Random(3)
    for _ in range(60):
        points = np.array(sorted(r.sample(range(1, 60), r.randint(1, 8))))
        counts = np.array([r.randint(1, 9) for _ in points])
        k = r.randint(1, 4)

        def cost(bounds):
            return sum(int(c) * min(b for b in bounds if b >= p) for p, c in zip(points, counts))

        best = min(cost((*some, points[-1])) for n in range(min(k, len(points))) for some in itertools.combinations(points[:-1].tolist(), n))
        got = length_buckets.best_bounds(points, counts, k)
        assert cost(got) == best and len(got) <= k and got[-1] == points[-1]


def test_grid(spark):
    xs = [0, 1, 64, 65, 65_536, 65_537, 131_072, 131_073, 10**9]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x long").select(length_buckets.on_grid(F.col("x"))).collect()]
    assert all(g >= x and g - x <= max(64, x // 32) for g, x in zip(got, xs)) and got[:6] == [64, 64, 64, 128, 65_536, 66_560]


def test_packing(spark):
    r = random.Random(4)
    rows = [(i, "x" * r.choice([1, 50, 200, 3000])) for i in range(300)] + [(300, None), (301, ""), (None, "y"), (5, "dup"), (302, "z" * 50_000), (303, "z" * 3_000_000), (302, "z" * 50_000)]
    docs = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, bucket int")
    got = length_buckets.packed(docs, F.octet_length("text"), buckets=4, token_budget=10_000).collect()
    assert len(got) == len(rows) and len({x.bucket for x in got}) <= 4
    for x in got:
        assert x.length <= x.bound and x.padding == x.bound - x.length and 0 <= x.place < x.batch_rows and x.batch_rows == max(1, 10_000 // x.bound)
    places = [(x.bucket, x.batch, x.place) for x in got]
    assert len(set(places)) == len(places)
    for b in {x.bucket for x in got}:
        own = [x for x in got if x.bucket == b]
        assert max(x.batch for x in own) == (len(own) - 1) // own[0].batch_rows
    assert length_buckets.packed(docs.limit(0), F.octet_length("text")).count() == 0


def test_bounds_are_lengths(spark):
    lengths = [65] * 50 + [0, 1, 130, 130, 131, 7000]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n long")
    for k in (1, 2, 3, 4):
        got = length_buckets.packed(docs, F.col("n"), buckets=k).collect()
        some = sorted(set(lengths[:-1]) - {0, 130})
        least = min(sum(min(b for b in (*c, 7000) if b >= n) - n for n in lengths) for c in itertools.combinations(some, min(k - 1, len(some))))
        assert sum(x.padding for x in got) == least and all(x.padding == 0 for x in got if x.length == 65 and k > 2)
    zero = length_buckets.packed(docs.where("n = 0"), F.col("n")).first()
    assert (zero.length, zero.bound, zero.place) == (0, 1, 0)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(120), prose(60)
    texts = [base, base, base + " " + prose(3), prose(100) + " " + passage, prose(100) + " " + passage, prose(150), "few words", None, "### " * 80, prose(90)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns, name
    kept = {x.doc_id: x for x in out.collect()}
    assert sorted(kept) == [0, 3, 4, 5, 9]
    assert passage not in kept[3].text and passage not in kept[4].text and kept[5].text == texts[5] and kept[3].n_chars == len(kept[3].text)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in final) == [0, 3, 4, 5, 9]


def test_pipeline_cuts_51_short_words(spark):
    import corpus_pipeline

    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    prose = lambda n: " ".join(word() for _ in range(n))
    long, short = prose(51), prose(50)
    assert len(long) < 256
    texts = [prose(90) + " " + long, long + " " + prose(90), prose(90) + " " + short, short + " " + prose(90)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id: x.text for x in corpus_pipeline.passage_dedup(spark, docs, "").collect()}
    assert long not in kept[0] and long not in kept[1] and (kept[2], kept[3]) == (texts[2], texts[3])


def test_pipeline_edges(spark, tmp_path):
    """Null and repeated ids, repeated rows, a very long text, extra columns named like a stage's own, no rows at all."""
    import corpus_pipeline

    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(n))
    a, b, c, d = (prose(90) for _ in range(4))
    rows = [(1, a), (1, a), (None, b), (None, c), (2, prose(60_000)), (3, d), (3, prose(80)), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), k, "x", 0.5) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, node long, spans string, length double")
    docs.write.parquet(f"{tmp_path}/some/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "")
        assert out.columns == docs.columns
    kept = out.collect()
    assert sorted((x.doc_id or 0, x.text[:50]) for x in kept) == sorted((i or 0, t[:50]) for i, t in rows[1:7]) and all(x.n_chars == len(x.text) and x.spans == "x" for x in kept)
    final = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert sorted(x.doc_id or 0 for x in final) == [0, 0, 1, 2, 3, 3] and len({(x.bucket, x.batch, x.place) for x in final}) == 6
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
