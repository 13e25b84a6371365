import random
from collections import Counter

import pytest

from ledgerloom.llm.rollup import Rollup, count_tokens, deltas
from ledgerloom.llm.tokens import default_path

COLUMNS = "op string, source string, lang string, tokenizer_version string, n_tokens long, old_tokens long, n_docs int"


def test_batches_against_recount(spark, tmp_path):
    r = random.Random(1)
    rollup = Rollup(spark, f"file://{tmp_path}/r", compact_every=2)
    assert rollup.totals().count() == 0
    live = {}
    for batch in range(7):
        changes = []
        for _ in range(60):
            k = (r.choice(["a", None, "b"]), r.choice(["en", None]), r.choice(["v1", "v2"]))
            if r.random() < 0.5 or not live:
                live[len(live), batch, len(changes)] = (k, n := r.randrange(50))
                changes.append(("insert", *k, n, None, 1))
            else:
                i = r.choice(list(live))
                k, old = live[i]
                if r.random() < 0.5:
                    del live[i]
                    changes.append(("DELETE", *k, None, old, 1))
                else:
                    live[i] = (k, n := r.randrange(50))
                    changes.append(("revise", *k, n, old, 1))
        df = spark.createDataFrame(changes, COLUMNS)
        assert rollup.commit(f"b{batch}", df) and not rollup.commit(f"b{batch}", df)
        docs, tokens = Counter(), Counter()
        for k, n in live.values():
            docs[k] += 1
            tokens[k] += n
        got = {tuple(x)[:3]: tuple(x)[3:] for x in rollup.totals().collect()}
        assert got == {k: (docs[k], tokens[k]) for k in docs}
    assert rollup.batches() == {f"b{k}" for k in range(7)} == Rollup(spark, f"file://{tmp_path}/r").batches()
    # three snapshots so far, of which the last two are kept, with the batches that the older one lacks
    assert sorted(n for n in rollup._names()) == ["batch=b4", "batch=b5", "batch=b6", "snapshot=2", "snapshot=3"]


def test_a_batch_that_fails_leaves_no_trace(spark, tmp_path):
    rollup = Rollup(spark, f"file://{tmp_path}/r")
    good = spark.createDataFrame([("insert", "a", "en", "v", 5, None, 1)], COLUMNS)
    for op in ("upsert", None):
        with pytest.raises(Exception, match="no such operation"):
            rollup.commit("x", spark.createDataFrame([(op, "a", "en", "v", 5, None, 1)], COLUMNS))
    with pytest.raises(Exception, match="no count"):
        rollup.commit("x", spark.createDataFrame([("delete", "a", "en", "v", 5, None, 1)], COLUMNS))
    with pytest.raises(ValueError, match="batch id"):
        rollup.commit("../x", good)
    assert rollup.batches() == set() and rollup.totals().count() == 0
    assert rollup.commit("x", good) and rollup.commit("empty", good.limit(0))
    assert [tuple(x) for x in rollup.totals().collect()] == [("a", "en", "v", 1, 5)]
    assert deltas(good.limit(0)).count() == 0


def test_documents_move_and_repeats_count_once(spark):
    schema = COLUMNS.replace(", n_docs int", "") + ", old_source string, old_lang string, old_tokenizer_version string, doc_id long"
    rows = [
        ("insert", "a", "en", "v1", 5, None, None, None, None, 1),
        ("insert", "a", "en", "v1", 5, None, None, None, None, 1),
        ("revise", "b", None, "v2", 7, 4, "a", "en", "v1", 2),
        ("insert", "a", "en", "v1", 1, None, None, None, None, None),
        ("insert", "a", "en", "v1", 1, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    sums = lambda key: {tuple(x)[:3]: tuple(x)[3:] for x in deltas(df, key).collect()}
    assert sums(("op", "doc_id")) == {("a", "en", "v1"): (2, 3), ("b", None, "v2"): (1, 7)}
    assert sums(()) == {("a", "en", "v1"): (3, 8), ("b", None, "v2"): (1, 7)}


def test_counts(spark):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(default_path())
    rows = [(1, "Hello, World! don't", "s", "en", 9), (1, "Hello, World! don't", "s", "en", 9), (2, None, None, None, None), (None, "é x", "s", "fr", 1), (3, "ab " * 20_000, "t", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_tokens int")
    got = sorted((str(x.doc_id), x.n_tokens) for x in count_tokens(df, "v", extra=1).collect())
    assert got == sorted((str(d), 1 + len(hf.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows)
    assert count_tokens(df.limit(0), "v").count() == 0


def test_query_against_brute_force(spark):
    from tokenizers import Tokenizer

    from ledgerloom.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    hf = Tokenizer.from_file(default_path())
    toxic = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").collect()}
    docs, tokens = Counter(), Counter()
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        if r.doc_id not in toxic:
            docs[r.source, r.lang] += 1
            tokens[r.source, r.lang] += len(hf.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = {(x.source, x.lang, x.tokenizer_version): (x.n_docs, x.n_tokens) for x in QUERIES["op9_token_rollup"](spark, d).collect()}
    assert got == {(*k, "word_bpe_49k+end"): (docs[k], tokens[k]) for k in docs}
