import random
import re
from collections import Counter

from ledgerloom.llm import decontam
from ledgerloom.llm.decontam import contaminated

VOCAB = [f"Wört{i}" if i % 7 == 0 else f"w{i}" for i in range(400)]


def plain_words(t):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def grams(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items, threshold=0.8):
    prepared = [(i, plain_words(t)) for i, t in items]
    sets = [(i, w, grams(w, min(5, len(w)))) for i, w in prepared if w]
    out = {}
    for d, t in docs:
        w = plain_words(t)
        for i, iw, g in sets:
            best = 0.0
            for s in range(max(1, len(w) - len(iw) + 1)):
                x = grams(w[s : s + len(iw)], min(5, len(iw)))
                both = sum(min(n, g[k]) for k, n in x.items())
                every = sum(x.values()) + sum(g.values())
                best = max(best, both / (every - both))
            if best >= threshold:
                out[d, i] = round(best, 9)
    return out


def make(seed=4):
    r = random.Random(seed)
    items = [(i, " ".join(r.choice(VOCAB) for _ in range(r.choice([1, 3, 5, 15, 40, 59])))) for i in range(20)]
    items += [(20, None), (21, " ,. "), (22, items[5][1]), (23, " ".join(["again"] * 20))]
    docs = []
    for d in range(120):
        w = [r.choice(VOCAB) for _ in range(r.randrange(0, 150))]
        if d % 2:
            x = (r.choice(items[:20])[1]).split()
            for _ in range(r.randrange(4)):
                x[r.randrange(len(x))] = "other"
            if r.random() < 0.3:
                x.insert(r.randrange(len(x)), "new")
            w[5:5] = x
        text = "".join(c + r.choice([" ", ", ", "\n", "! "]) for c in w)
        docs.append((d, text.upper() if d % 5 == 0 else text))
    docs += [(300 + i, " ".join(x[1].split()[a : len(x[1].split()) - b])) for i, (x, a, b) in enumerate([(items[k], a, b) for k in range(20) for a, b in ((0, 2), (3, 0), (0, 1), (9, 0))])]
    docs += [(200, None), (201, ""), (202, " ".join(["again"] * 9000)), (203, items[6][1])]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = make()
    want = brute([d for d in docs if d[0] != 202], items)
    assert len(want) > 30
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int")
    for size in (decontam.PART_BYTES, 700):
        monkeypatch.setattr(decontam, "PART_BYTES", size)
        got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in contaminated(df, bench).collect()}
        assert got.pop((202, 23)) == 1.0
        assert got == want


def test_edges_of_the_input(spark):
    text = " ".join(VOCAB[:30])
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, text)], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in contaminated(df, bench).collect()) == ["1", "1", "None"]
    assert contaminated(df, bench.limit(0)).count() == 0
    assert contaminated(df.limit(0), bench).count() == 0


def test_tables(spark):
    """All documents that hold a whole item, in lower-case words, are found, and no others."""
    from ledgerloom.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: " " + " ".join(plain_words(r.text)) + " " for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = {r.item_id: " " + " ".join(plain_words(r.text)) + " " for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    want = {(a, b) for a, x in docs.items() for b, y in items.items() if y in x}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, d).collect()}
    assert want and want == got


def test_the_index_proposes_the_items(monkeypatch):
    """Without the block tables nothing is found, and a radius of 0 leaves only exact copies."""
    import pyarrow as pa

    docs, items = make()
    texts = pa.array([t for _, t in docs])
    b = decontam.Benchmark([t for _, t in items])
    found = b.search(texts, 0.8)
    assert any(x[3] < 1 for x in found) and any(x[3] == 1 for x in found)
    monkeypatch.setattr(decontam.MultiIndex, "candidates", lambda self, f: 0)
    assert b.search(texts, 0.8) == []
    monkeypatch.undo()
    monkeypatch.setattr(decontam, "RADIUS", 0)
    assert {x[3] for x in decontam.Benchmark([t for _, t in items]).search(texts, 0.8)} == {1.0}


def test_oracle(spark):
    from ledgerloom.llm.queries import ORACLES, QUERIES
    from tests.llm.oracle import same

    same(spark, QUERIES["op7_decontamination"], ORACLES["op7_decontamination"], "/root/testdata/sf0.001")
