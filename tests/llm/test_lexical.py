"""Search against brute force in plain Python, at several sizes of shards and parts, and against SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm.lexical import best_of_shard, build_index, search
from ledgerloom.llm.queries import ORACLES, QUERIES
from oracle import same

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    own = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in own:
            score = 0
            for t in terms(text):
                if t in c:
                    m = 100 - 75 + 75 * n * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(400)] + ["É", "日本", "Don't", "A-B", "x9", "the", "The"]
    docs = [(r.choice([k, k, k, None, 7]), " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 40, 200])))) for k in range(n)]
    docs += [(900, None), (901, ""), (902, "... !!"), (903, "same text here w1"), (904, "same text here w1"), (904, "same text here w1"), (5000, "w1 w2 " * 5000)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 30)))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "?!"), (103, "absent"), (104, "same text here"), (104, "w1 w1 w1 w2"), (104, "w1 w1 w1 w2"), (None, "the the THE"), (105, "w1 w2 " * 300)]
    return docs, items


@pytest.mark.parametrize(("shard_bytes", "part_bytes", "k"), [(1 << 20, 1 << 20, 10), (3000, 1 << 20, 3), (3000, 900, 10), (1, 1 << 20, 1)])
def test_equals_brute_force(spark, shard_bytes, part_bytes, k):
    docs, items = corpus(k, 150)
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, rid string, score int").repartition(3)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int").repartition(2)
    index = build_index(rows, shard_bytes=shard_bytes)
    assert (index.count() > 5) == (shard_bytes <= 3000)
    got = search(index, asked, k=k, part_bytes=part_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, k)


def test_empty(spark):
    docs, items = corpus(1, 5)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    index = build_index(rows)
    assert search(index, asked.limit(0)).collect() == []
    assert search(index, asked.where("text is null or text = '?!'")).collect() == []
    assert search(build_index(rows.limit(0)), asked).collect() == []
    assert search(build_index(rows.where("text is null")), asked).collect() == []



def test_best_of_shard():
    r = np.random.default_rng(3)
    for _ in range(500):
        n, k = int(r.integers(1, 60)), int(r.integers(1, 6))
        lists = []
        for _ in range(r.integers(0, 8)):
            docs = np.flatnonzero(r.random(n) < r.random()).astype(np.int32)
            if len(docs):
                lists.append((docs, r.integers(0, 10 ** int(r.integers(1, 5)), len(docs))))
        bounds = [int(g.max()) for _, g in lists]
        want = np.zeros(n, np.int64)
        for docs, gain in lists:
            want[docs] += gain
        ranked = np.sort(want[want > 0])[::-1]
        reached = int(ranked[k - 1]) if len(ranked) >= k else 0
        for floor in {0, reached // 2, reached}:
            scores = np.zeros(n, np.int64)
            found = best_of_shard(lists, bounds, scores, k, floor)
            assert set(np.flatnonzero((want >= reached) & (want > 0))) <= set(found)
            assert (scores[found] == want[found]).all()


def test_weak_lists_are_probed_only():
    """A long list that cannot lift a document to the floor gives scores to candidates alone."""
    strong, weak = np.array([3, 5], np.int32), np.arange(1000, dtype=np.int32)
    scores = np.zeros(1000, np.int64)
    found = best_of_shard([(weak, np.ones(1000, np.int64)), (strong, np.array([50, 60]))], [1, 60], scores, 2, 0)
    assert found.tolist() == [3, 5] and np.flatnonzero(scores).tolist() == [3, 5] and scores[[3, 5]].tolist() == [51, 61]


def test_query_equals_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        same(spark, QUERIES["op11_lexical"], ORACLES["op11_lexical"], f"/root/testdata/{sf}")
