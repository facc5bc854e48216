"""Near-duplicate and repeated-string operators beside brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from modwarden.llm import common, induced_sort, lattice_dedup, odd_minhash, shingles, suffix_dedup


def closure(ids, pairs):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_minhash(rows, width, percent):
    sets = {}
    for d, x in rows:
        w = (x or "").encode().lower().split()
        n = min(width, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    top = closure(ids, links)
    return {d: (len(sets[d]), top[d]) for d in ids}


def near_copies(seed):
    r = random.Random(seed)
    words, rows = [f"w{i}" for i in range(400)], []
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randint(3, 90))]
        for _ in range(r.choice([1, 2, 5, 40])):
            x = list(base)
            for _ in range(r.randint(0, max(1, len(x) // 30))):
                x[r.randrange(len(x))] = r.choice(words)
            rows.append((len(rows), " ".join(x)))
    n = len(rows)
    return rows + [(n, ""), (n + 1, None), (n + 2, " \n"), (n + 3, rows[0][1].upper()), (n + 4, "one"), (n + 5, "ONE")]


def test_minhash(spark, monkeypatch):
    monkeypatch.setattr(odd_minhash, "CHUNK", 15)
    rows = near_copies(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in odd_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == plain_minhash(rows, 4, 80)


def test_minhash_edges(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (None, "a b c d e f", "z"), (3, None, "z"), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id or 0), r.component_id or 0, r.kept) for r in odd_minhash.near_duplicates(docs).collect())
    assert got == [(0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True)]
    left = odd_minhash.first_of_groups(docs)
    assert left.columns == docs.columns and sorted((r.doc_id, r.text) for r in left.collect() if r.text) == [(1, "a b c d e f")]
    assert odd_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_null_and_repeated_ids(spark):
    r = random.Random(9)
    prose = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e = (prose() for _ in range(5))
    rows = [(3, a), (5, a + " end"), (5, b), (None, a), (None, c), (None, d), (7, e), (7, e), (None, e + " end"), (8, " "), (8, " "), (8, ""), (8, None), (None, None), (None, None)]
    left = odd_minhash.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(3, a), (5, b), (None, c), (None, d), (7, e), (8, " "), (8, " "), (8, ""), (8, None), (None, None), (None, None)]
    assert sorted(map(tuple, left), key=repr) == sorted(want, key=repr)


def test_minhash_one_row_of_a_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    for i in (4, None):
        left = odd_minhash.first_of_groups(spark.createDataFrame([(i, text), (i, text + " end"), (i, text.upper()), (i, "another text")], "doc_id long, text string")).collect()
        assert len(left) == 2 and (i, "another text") in left


def test_odd_sketch_estimates():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        base = r.integers(1, 2**63, 900, dtype=np.uint64)
        a, b = base[:850], base[50:]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (np.frombuffer(odd_minhash.odd_sketch(odd_minhash.samples(s)), np.uint64) for s in (a, b))
        errors.append(float(odd_minhash.estimated(np.bitwise_count(x ^ y).sum())) - true)
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < odd_minhash.SLACK


def test_sketch_misses_less_than_bands():
    """The exact chance that a pair at the threshold is put below the slack: each differing sample flips two bits."""
    n, k = odd_minhash.SAMPLES, np.arange(odd_minhash.BITS + 1)
    p, total = np.where(k == 0, 1.0, 0.0), np.zeros(odd_minhash.BITS + 1)
    for d in range(n + 1):
        total += math.comb(n, d) * 0.2**d * 0.8 ** (n - d) * p
        for _ in range(2):
            up, down = p * (odd_minhash.BITS - k) / odd_minhash.BITS, p * k / odd_minhash.BITS
            p = np.concatenate(([0.0], up[:-1])) + np.concatenate((down[1:], [0.0]))
    assert total[odd_minhash.estimated(k) < 0.8 - odd_minhash.SLACK].sum() < (1 - 0.8**4) ** odd_minhash.BANDS


def test_shingle_sets():
    assert len(shingles.shingle_set(None, 5)) == 0 and len(shingles.shingle_set("a b", 5)) == 1
    assert np.array_equal(shingles.shingle_set("A  b\tc", 2), shingles.shingle_set("a b c", 2))
    assert len(shingles.shingle_set("a b a b a b", 2)) == 2


def test_suffix_array():
    r = random.Random(0)
    for _ in range(250):
        x = [r.randint(1, r.choice([1, 2, 3, 20])) for _ in range(r.randint(1, 70))]
        x = (x + x[: r.randint(0, len(x))] + x if r.random() < 0.4 else x) + [0]
        sa = induced_sort.suffix_array(np.array(x), 21)
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        lcp, before = induced_sort.permuted_lcp(np.array(x), sa, 10)
        for i in range(len(x)):
            j, c = before[i], 0
            while j >= 0 and max(i, j) + c < len(x) and x[i + c] == x[j + c]:
                c += 1
            assert lcp[i] == c


def plain_cut(rows, length):
    seen, bodies, out = collections.Counter(), [(d, (x or "").encode()) for d, x in rows], []
    for _, b in bodies:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    for d, b in bodies:
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((d, len(b), sum(hit), spans, hashlib.sha256(bytes(x for x, y in zip(b, hit) if not y)).hexdigest()))
    return sorted(out)


def passages(seed):
    r = random.Random(seed)
    draw = lambda n: "".join(r.choice("abcé ") for _ in range(n))
    shared, rows = [draw(n) for n in (450, 900, 380, 2000)], []
    for _ in range(60):
        t = draw(r.randint(0, 1200))
        for p in shared:
            if r.random() < 0.3:
                k = r.randint(0, len(t))
                t = t[:k] + p + t[k:]
        rows.append((len(rows), t))
    more = ["", None, "a" * 1500, "ab" * 900, "x" * 399, "y" * 400, "y" * 401, rows[5][1], rows[5][1], "from " * 300 + draw(50), "from " * 200 + draw(60)]
    return rows + [(len(rows) + i, x) for i, x in enumerate(more)]


def test_suffix_dedup(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 20_000)
    rows = passages(3)
    got = sorted(map(tuple, suffix_dedup.cut_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert [r[:5] for r in got] == plain_cut(rows, 400)


def test_suffix_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", 0)
    rows = passages(4)[-15:]
    got = sorted(map(tuple, suffix_dedup.cut_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert [r[:5] for r in got] == plain_cut(rows, 400)


def test_cut_texts(spark):
    p = "é" * 200
    docs = spark.createDataFrame([(1, "x" + p + "left", 9), (2, "right" + p, 9), (3, None, 9), (None, "own", 9)], "doc_id long, text string, spans long")
    got = suffix_dedup.without_repeats(docs, length=300)
    assert got.columns == docs.columns and sorted(((r.doc_id or 0), r.text) for r in got.collect()) == [(0, "own"), (1, "xleft"), (2, "right"), (3, None)]
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0


def plain_passages(rows, words):
    seen, cut = collections.Counter(), [(d, x, x.split()) for d, x in rows]
    for _, _, w in cut:
        seen.update(tuple(w[i : i + words]) for i in range(len(w) - words + 1))
    out = []
    for d, _, w in cut:
        hit = [False] * len(w)
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i : i + words])] > 1:
                hit[i : i + words] = [True] * words
        out.append((d, [x for x, y in zip(w, hit) if not y]))
    return sorted(out)


def worded(seed):
    r = random.Random(seed)
    draw = lambda n: "".join(r.choice("abcdefgh") + r.choice("  \n") for _ in range(n)).split()
    own = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    shared, rows = [draw(n) for n in (51, 50, 30, 30, 120)], []
    for _ in range(50):
        t = own(r.randint(0, 90))
        for p in shared:
            if r.random() < 0.3:
                t += p + own(r.choice([0, 0, 5]))
        rows.append((len(rows), "".join(w + r.choice([" ", "\n", "  "]) for w in t)))
    more = ["", "a " * 300, "a b " * 90, "x " * 50, "y " * 51, rows[5][1], rows[5][1], "z " * 20, "z " * 20]
    return rows + [(len(rows) + i, x) for i, x in enumerate(more)]


def test_passages_of_short_words(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    monkeypatch.setattr(suffix_dedup, "SHARD_WORDS", 2_000)
    rows = worded(5)
    docs = spark.createDataFrame(rows + [(None, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.without_passages(docs).collect()}
    want = plain_passages(rows, 51)
    assert got.pop(None) is None and sorted((d, x.split()) for d, x in got.items()) == want
    assert any(len(w) < len(x.split()) for (_, w), (_, x) in zip(want, rows))
    assert all(got[d] == x for (d, x), (_, w) in zip(rows, want) if len(w) == len(x.split()))
    assert suffix_dedup.without_passages(docs.limit(0)).count() == 0


def plain_left(rows, length, words):
    """Texts without strings of `length` bytes and passages of `words` words that stand elsewhere."""
    strings, runs, out = collections.Counter(), collections.Counter(), {}
    cut = [(d, x, [(m.start(), m.end()) for m in re.finditer(r"\S+", x)]) for d, x in rows]
    tokens = lambda x, w: tuple(x[a:b] for a, b in w)
    for _, x, w in cut:
        strings.update(x[i : i + length] for i in range(len(x) - length + 1))
        runs.update(tokens(x, w[i : i + words]) for i in range(len(w) - words + 1))
    for d, x, w in cut:
        spans = [(i, i + length) for i in range(len(x) - length + 1) if strings[x[i : i + length]] > 1]
        spans += [(w[i][0], w[i + words - 1][1]) for i in range(len(w) - words + 1) if runs[tokens(x, w[i : i + words])] > 1]
        hit = {k for a, b in spans for k in range(a, b)}
        out[d] = "".join(c for k, c in enumerate(x) if k not in hit)
    return out


@pytest.mark.parametrize(("length", "hot", "broadcast"), [(400, 500, 500_000), (150, 8, 500_000), (150, 8, 0)])
def test_cut_report_without_passages(spark, monkeypatch, length, hot, broadcast):
    """op10's text lacks passages of over 50 words of fewer bytes than its law too; the digests are those of the law."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 700)
    r = random.Random(7)
    rows = worded(5)
    long = [f"q{k}" for k in range(70)]
    # the long passage repeats by its bytes in two texts, and a part of it by its words only in others
    rows += [(len(rows), "one " + " ".join(long)), (len(rows) + 1, " ".join(long) + " two"), (len(rows) + 2, "three " + "  ".join(long[5:60]) + " end"), (len(rows) + 3, "\t".join(long[9:59]))]
    docs = spark.createDataFrame(r.sample(rows, len(rows)) + [(-1, None)], "doc_id long, text string")
    got = suffix_dedup.cut_report(docs, length=length, words=51).collect()
    assert sorted(tuple(x)[:5] for x in got) == plain_cut([*rows, (-1, None)], length)
    texts = {x.doc_id: x.text for x in got}
    assert texts.pop(-1) is None and texts == plain_left(rows, length, 51)
    assert any(x.n_removed == 0 and x.n_bytes > len(x.text) for x in got if x.text is not None)
    assert suffix_dedup.cut_report(docs.limit(0), words=51).count() == 0


def test_texts_side_by_side():
    """Segments and words of texts taken together are those of each alone."""
    r = random.Random(2)
    for _ in range(60):
        texts = [bytes(r.choice(b"ab c") for _ in range(r.choice([0, 3, 20, 21, 60, 200]))) for _ in range(r.randint(1, 6))] + [b"a b"]
        raw, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in texts])))
        for symbols, length in ((suffix_dedup.BYTES, 20), (suffix_dedup.WORDS, 5)):
            values, at, _, _ = symbols.of(raw, bounds)
            got, want = list(zip(*(x.tolist() for x in suffix_dedup.segments_of(values, at, length, 4)))), []
            for i, x in enumerate(texts):
                alone, own, _, _ = symbols.of(np.frombuffer(x, np.uint8), np.array([0, len(x)]))
                assert alone.tolist() == values[at[i] : at[i + 1]].tolist()
                found = list(zip(*(y.tolist() for y in suffix_dedup.segments_of(alone, own, length, 4))))
                assert [k for y in found for k in range(y[2], y[3] + 1)] == list(range(len(alone) - length + 1))
                want += [(*y[:4], i) for y in found]
            assert got == want


def test_words_without_spaces(spark):
    r = random.Random(6)
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    p, a, b = han(60), han(9), han(9)
    docs = spark.createDataFrame([(1, f"{a}{p}{b}"), (2, f"x{p}"), (3, f"{p[:50]}y")], "doc_id long, text string")
    assert {x.doc_id: x.text for x in suffix_dedup.without_passages(docs).collect()} == {1: a + b, 2: "x", 3: f"{p[:50]}y"}


def plain_links(rows, least):
    good = [(i, np.array(v, dtype="f8")) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, pairs = collections.Counter(), []
    for k, (i, a) in enumerate(good):
        for j, b in good[:k]:
            if len(a) == len(b) and (a @ b) / np.sqrt((a @ a) * (b @ b)) >= least:
                n[i] += 1
                n[j] += 1
                pairs.append((i, j))
    top = closure([i for i, _ in rows], pairs)
    return {i: (n[i], top[i]) for i, _ in rows}


def test_lattice(spark, monkeypatch):
    monkeypatch.setattr(lattice_dedup, "CHUNK", 16)
    r = np.random.default_rng(0)
    rows = []
    for _ in range(15):
        c = r.standard_normal(24)
        c /= np.linalg.norm(c)
        for _ in range(int(r.choice([1, 2, 40]))):
            v = c + 0.03 * r.standard_normal(24)
            rows.append((len(rows), [float(x) for x in np.float32(v)]))
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 24), (n + 2, [float("nan")] * 24), (n + 3, rows[0][1]), (n + 4, [2 * x for x in rows[0][1]]), (n + 5, []), (n + 6, [1.0, 2.0]), (n + 7, [1.0, 2.0]), (n + 8, [None, 1.0])]
    v = spark.createDataFrame([(i, x, "c") for i, x in rows], "vec_id long, embedding array<float>, n_links string")
    got = {x.vec_id: (x.n_links, x.component_id) for x in lattice_dedup.near_duplicates(v).collect()}
    want = plain_links(rows, 0.95)
    assert set(got) == set(want)
    assert got == want
    assert lattice_dedup.near_duplicates(v.limit(0)).count() == 0


def test_lattice_points():
    r = np.random.default_rng(2)
    x = r.standard_normal((200, 8)) * 2
    p = lattice_dedup.e8_points(x, 2)
    half = p / 2
    assert np.all((p % 2 == p[:, :, :1] % 2)) and np.all(half.sum(axis=2) % 2 == 0)
    assert np.all(np.linalg.norm(half[:, 0] - x, axis=1) <= 1.0 + 1e-9)


def test_lattice_recall():
    r = np.random.default_rng(3)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    a = unit(r.standard_normal((2000, 64)))
    d = r.standard_normal((2000, 64))
    d = unit(d - (d * a).sum(axis=1, keepdims=True) * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * d
    x, y = lattice_dedup.cell_keys(a).reshape(2000, lattice_dedup.TABLES, -1), lattice_dedup.cell_keys(b).reshape(2000, lattice_dedup.TABLES, -1)
    assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= 0.99


def test_components(spark):
    r = random.Random(8)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(60)] + [(5, 5)]
    links = spark.createDataFrame(pairs, "a long, b long")
    got = {x.node: x.component_id for x in common.components(links).collect()}
    want = closure({x for p in pairs for x in p}, pairs)
    assert all(got.get(i, i) == want[i] for i in want)
    assert common.components(links.where(F.lit(False))).count() == 0


def test_lattice_ids(spark):
    """Null and repeated ids, repeated rows, a dense group wider than a core, vectors of doubles."""
    r = np.random.default_rng(4)
    base = r.standard_normal(16)
    near = [base + s * r.standard_normal(16) for s in [0.01] * 60 + [0.25] * 60]
    rows = [(i, v.tolist()) for i, v in enumerate(near)] + [(3, near[0].tolist()), (None, near[1].tolist()), (None, r.standard_normal(16).tolist()), (500, near[5].tolist()), (500, near[5].tolist()), (501, (-base).tolist())]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    m = np.stack([np.array(v) for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    links = (m @ m.T >= 0.95).sum(axis=1) - 1
    assert 60 < np.median(links) < 123  # some pairs are linked in a core, some outside, some not
    got = lattice_dedup.near_duplicates(docs).collect()
    assert sorted((x.vec_id if x.vec_id is not None else -1, x.n_links) for x in got) == sorted((i if i is not None else -1, int(n)) for (i, _), n in zip(rows, links))
    by = {x.vec_id: x for x in got}
    assert by[501].component_id == 501 and by[501].n_links == 0 and {x.component_id for x in got if x.n_links} == {0}
    assert sorted(x.component_id is None for x in got if x.vec_id is None) == [False, True]


def test_minhash_long_texts(spark, monkeypatch):
    """Texts of many shingles are cut into groups by those, and a text of one long word is a set of one."""
    monkeypatch.setattr(odd_minhash, "CHUNK_SHINGLES", 3_000)
    r = random.Random(12)
    base = [f"w{r.randrange(10**6)}" for _ in range(4000)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 4000, 400)] + ["y" * 5_000_000, "z" * 5_000_000, "y" * 5_000_000]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in odd_minhash.near_duplicates(docs).collect()}
    assert {c for i, (_, c) in got.items() if i < 10} == {0} and [got[i] for i in (10, 11, 12)] == [(1, 10), (1, 11), (1, 10)]


def test_cut_report_edges(spark):
    p = "".join(random.Random(5).choice("abcdefg ") for _ in range(450))
    rows = [(1, p + "é one", "a"), (1, p + "é one", "a"), (None, "two " + p, "b"), (2, None, "c"), (3, "", "c"), (4, "q" * 3_000_000, "c"), (5, "own text", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = suffix_dedup.cut_report(docs).collect()
    want = plain_cut([(d if d is not None else -1, t) for d, t, _ in rows if d != 4], 400)
    assert sorted((x.doc_id if x.doc_id is not None else -1, *x[1:5]) for x in got if x.doc_id != 4) == want
    by = {x.doc_id: x for x in got}
    assert (by[4].n_removed, by[4].n_spans, by[4].text) == (3_000_000, 1, "") and by[2].text is None and by[5].text == "own text" and by[None].text == "two "
    assert suffix_dedup.cut_report(docs.limit(0)).count() == 0
