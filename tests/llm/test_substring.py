import hashlib
import random
import re

import numpy as np
import pytest

from ledgerloom.llm import substring
from ledgerloom.llm.substring import _sliding_min, dedup_substrings


def brute(rows, width=13):
    words = [(d, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for d, t in rows]
    least = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - width + 1):
                g = tuple(w[i : i + width])
                least[g] = min(least.get(g, d), d)
    out = []
    for d, w in words:
        gone = set()
        if d is not None:
            for i in range(len(w) - width + 1):
                if least[tuple(w[i : i + width])] < d:
                    gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def make(seed):
    r = random.Random(seed)
    words = [f"w{i}é" for i in range(30)] + ["a"]
    passages = [[r.choice(words) for _ in range(r.choice([12, 13, 14, 40, 90]))] for _ in range(12)]
    rows = []
    for d in r.sample(range(1000), 150):
        w = [r.choice(words) for _ in range(r.randrange(40))]
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            w += p if r.random() < 0.5 else p[a:]
            w += [r.choice(words) for _ in range(r.randrange(5))]
        rows.append((d, "".join(x + r.choice([" ", "\n", "\t ", "\x0b"]) for x in w)))
    rows += [(2000 + i, rows[i][1]) for i in range(40)]
    rows += [(3000, "a " * 500), (3001, "a " * 400), (3002, "a " * 12), (3003, "a " * 12), (3004, None), (3005, ""), (None, "a " * 40), (None, None), (3006, " \n"), (-5, rows[3][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, chunk", [(1, 1 << 23), (2, 3000)])
def test_against_brute_force(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(substring, "CHUNK_BYTES", chunk)
    rows = make(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kept string, chunk int")
    got = dedup_substrings(df).collect()
    want = brute(rows)
    assert sorted([(x.doc_id, x.n_words, x.n_removed, x.kept_sha256, x.kept) for x in got], key=str) == want
    words = {d: (t or "").split() for d, t in rows}
    for x in got:
        own, end = words[x.doc_id], 0
        for f in sorted(x.factors, key=lambda f: f.start):
            assert f.length >= 13 and f.ref_doc_id < x.doc_id and f.start >= end
            end = f.start + f.length
            assert own[f.start : end] == words[f.ref_doc_id][f.ref_start : f.ref_start + f.length]
        assert sum(f.length for f in x.factors) <= x.n_removed <= sum(f.length + 24 for f in x.factors)


def test_factors_are_greedy_and_borders_are_looked_up():
    # windows 0-4 copy document 1 from word 7; 5 and 6 are held by document 2; the factor ends at word 17
    start, ref, place = np.array([0, 1, 2, 3, 4, 5, 6, 17, 18]), np.array([1, 1, 1, 1, 1, 2, 2, 1, 1]), np.array([7, 8, 9, 10, 11, 0, 1, 50, 90])
    found, border = substring.factors(start, ref, place, 13)
    assert found == [(0, 17, 1, 7), (17, 13, 1, 50)]
    assert border.tolist() == [5, 6, 8]
    assert substring.factors(start[:0], ref[:0], place[:0], 13)[0] == []


def test_rows_that_repeat_an_id(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(20)) for c in "tu")
    rows = [(1, t), (5, t), (5, u), (6, u)]
    got = sorted((x.doc_id, x.n_removed) for x in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0), (5, 0), (5, 20), (6, 20)]


def test_edges_of_the_input(spark):
    schema = "doc_id long, text string"
    assert dedup_substrings(spark.createDataFrame([], schema)).count() == 0
    t = " ".join(f"x{i}" for i in range(20))
    rows = [(1, t), (1, t), (2, t), (2, t), (5, "z " + t)]
    got = sorted((x.doc_id, x.n_removed) for x in dedup_substrings(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 0), (1, 0), (2, 20), (2, 20), (5, 20)]


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for w in (1, 2, 3, 7, 8, 9):
        assert _sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(50 - w + 1)]


def test_oracle(spark):
    from ledgerloom.llm.queries import ORACLES, QUERIES
    from tests.llm.oracle import same

    same(spark, QUERIES["op2_substring"], ORACLES["op2_substring"], "/root/testdata/sf0.001")
