"""Each stage of the pipeline, over what its predecessor kept, against a plain version of its rule."""

from collections import Counter

import pytest

import corpus_pipeline
from ledgerloom.llm.common import written
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash_wide import brute as brute_documents

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(written(f(spark, out[-1], DIR), name))
    return out


def test_columns(tables):
    for t in tables[1:-1]:
        assert t.dtypes == tables[0].dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_dedup", "decontamination", "packing"]


def test_quality_classifier(spark, tables):
    from ledgerloom.llm.cotrain import score_documents

    kept = {r.doc_id for r in score_documents(tables[0], spark.read.parquet(f"{DIR}/labels.parquet")).collect() if r.kept}
    assert sorted(map(tuple, tables[1].collect())) == sorted(tuple(r) for r in tables[0].collect() if r.doc_id in kept)
    assert 0 < len(kept) < tables[0].count()


def test_line_dedup(tables):
    before = sorted(tables[1].collect(), key=lambda r: r.doc_id)
    gone = brute_lines([(r.doc_id, r.text) for r in before])
    want = {}
    for i, r in enumerate(before):
        text = "\n".join(x for p, x in enumerate(r.text.split("\n")) if p not in gone[i]) if gone[i] else r.text
        if text.split() or not gone[i]:
            want[r.doc_id] = (text, len(text))
    assert {r.doc_id: (r.text, r.n_chars) for r in tables[2].collect()} == want


def test_simhash_dedup(tables):
    rows = tables[2].collect()
    kept = brute_documents([(r.doc_id, r.text) for r in rows])
    assert sorted(map(tuple, tables[3].collect())) == sorted(tuple(r) for r in rows if r.doc_id in kept)


def test_decontamination(spark, tables):
    from tests.llm.test_decontam import plain_words

    items = [" " + " ".join(plain_words(r.text)) + " " for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in tables[3].collect() if any(x in " " + " ".join(plain_words(r.text)) + " " for x in items)}
    assert {r.doc_id for r in tables[4].collect()} == {r.doc_id for r in tables[3].collect()} - dirty


def test_packing_and_run(spark, tables):
    from tests.llm.test_packing import whole

    want = {r.doc_id: len(whole(r.text)) + 1 for r in tables[4].collect()}
    got = Counter()
    for r in corpus_pipeline.run(spark, DIR).collect():
        got[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want


def test_odd_rows_pass_through(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, None, None, None, None), (None, "x y", None, None, 3), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, tables_schema := "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        out = table
        for name, f in corpus_pipeline.STAGES:
            out = written(f(spark, out, DIR), name)
        assert out.count() <= 5 and (table is docs) == (out.count() > 0)
    assert tables_schema
