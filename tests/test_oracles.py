"""Some queries beside their SQL on the smallest tables; scripts/compare.py runs all of them."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry
from modwarden import source_queries
from modwarden.source_queries import SOURCE_QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["surface_signals", "risk_signals", "merged_candidates", "skeleton_hits", "moderation_verdicts", "knn_top1", "stable_ids", "triplets", "offender_rollup", "top_words", "phrase_containment", "semantic_verdicts", "label_states", "knn_filtered", *SOURCE_QUERIES]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df, res = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(res.columns)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    at = [res.columns.index(c) for c in order]
    assert got == sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=repr)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_labelled_texts_are_whole(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(source_queries, "BROADCAST_LABELS", most, raising=False)
    same = "x" * 60
    texts = [f"{same} one", f" {same} two  ", same, f'{same}, "quoted"\nline\r\n', f'{same} "\0"\n\0', f"{same} \\", "é😀" * 300_000, "short", "\uffff\uffff", "", None, f"{same} clean", f"{same} no label"]
    labels = [(i, 1) for i in range(len(texts) - 2)] + [(len(texts) - 2, 0), (99, 1)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted((r.text, r.n) for r in entry.queries()["labelled_texts"](spark, str(tmp_path)).collect())
    want = [(t or "").strip(" ") for t in texts[:-2]]
    assert got == sorted((hashlib.md5(t.encode()).hexdigest(), len(t)) for t in want * 2)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(con.sql(entry.oracle_sql()["labelled_texts"]).fetchall())


def test_every_query_of_the_library_has_sql():
    from modwarden.oracles import ORACLES
    from modwarden.queries import QUERIES
    from modwarden.source_oracles import SOURCE_ORACLES

    assert set(QUERIES) == set(ORACLES | SOURCE_ORACLES) and not set(ORACLES) & set(SOURCE_ORACLES)
