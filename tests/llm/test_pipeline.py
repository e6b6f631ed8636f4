"""The pipeline's stages by brute force, and run() as a whole."""

import os
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tests.llm import test_decontaminate as leaks
from tests.llm import test_simhash as marks
from tests.llm.test_simhash_near import jaccard

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ITEM = "once upon a time there was a small grey owl in the old oak"
LONE = [f"{i} the cat and dog number {i * 7919} went over {i * i} hills with {i * 31} friends" for i in range(40)]
ROWS = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(LONE)] + [
    (100, LONE[0].upper(), "en", "s0", 1),
    (101, LONE[1], "en", "s0", 1),
    (102, "Listen: " + ITEM + ".", "en", None, 1),
    (103, "12345 !!!", "en", "s1", 1),
    (104, None, None, None, None),
    (105, "word " * 20_000 + "end", "en", "s1", 1),
    (106, "word " * 20_001 + "end", "en", "s2", 1),
    (107, LONE[5], None, "s2", 1),
    (107, LONE[5], None, "s2", 1),
]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(ROWS, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def brute():
    """Ids that reach the mix."""
    with_letters = [r for r in ROWS if any(c.isalpha() for c in r[1] or "")]
    best = {}
    for r in with_letters:
        key = marks.by_hand.__globals__["re"].sub("[A-Z]", lambda m: m[0].lower(), r[1])
        best[key] = max(best.get(key, r), r)
    docs = {r[0]: r for r in best.values()}
    alike = {(a, b): jaccard(docs[a][1], docs[b][1]) for a in docs for b in docs if a < b}
    assert not any(0.6 < j < 0.9 for j in alike.values())
    pairs = [pair for pair, j in alike.items() if j >= 0.8]
    docs = {i: docs[i] for i in set(marks.classes(pairs, docs).values())}
    hits = leaks.expected(docs.values(), [(1, ITEM)])
    return {i for i, *_, contaminated in hits if not contaminated}


def test_stages_by_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{i}"))
        docs = spark.read.parquet(str(tmp_path / f"{i}"))
        assert docs.columns == COLUMNS, name
    want = brute()
    assert sorted(r.doc_id for r in docs.collect()) == sorted(want)
    assert 102 not in want and 103 not in want and 100 in want and 0 not in want and not {105, 106} <= want
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in mix.collect()} <= want
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} <= want


def test_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
def test_clean_documents_of_the_test_tables_stay(spark, tmp_path):
    """Up to the mix, only copies, near copies and leaks may go."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / f"{i}"))
        docs = spark.read.parquet(str(tmp_path / f"{i}"))
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    best = {}
    for i, t in rows:
        best[(t or "").lower()] = max(i, best.get((t or "").lower(), i))
    texts = dict(rows)
    ids = sorted(best.values())
    alike = {(a, b): jaccard(texts[a], texts[b]) for a in ids for b in ids if a < b}
    leaked = {i for i, *_, bad in leaks.expected([(i, texts[i]) for i in ids], items) if bad}
    clean = {i for i in ids if not any(j > 0.6 and i in pair for pair, j in alike.items())}
    assert clean - leaked <= kept and not kept & leaked
    surely = [pair for pair, j in alike.items() if j >= 0.85]
    assert not [pair for pair in surely if set(pair) <= kept]
