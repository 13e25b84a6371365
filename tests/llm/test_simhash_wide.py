import random

import corpus_pipeline
from ledgerloom.llm import simhash_wide as similar


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    root = {i: i for i, _ in rows}
    sets = {i: grams(t) for i, t in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in root}


def test_the_stage_keeps_one_of_each_similar_group(spark, monkeypatch):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choice(vocab) for _ in range(40))
    base = [" ".join(r.choice(vocab) for _ in range(r.choice([3, 30, 120, 400]))) for _ in range(30)]
    texts = [*base, None, "", " \n", base[0].upper(), *(f"{passage} {x}" for x in base)]
    for _ in range(150):
        w = r.choice(texts[30:] if r.random() < 0.5 else base) or "a b"
        w = w.split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    r.shuffle(rows)
    want = brute(rows)
    assert 40 < len(want) < len(rows) - 60
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in corpus_pipeline.simhash_dedup(spark, df, "").collect()} == want
    monkeypatch.setattr(similar, "BLOCK", 4)
    assert {x.doc_id for x in similar.one_of_similar(df).collect()} == want
    # the comparison of fingerprints decides: at a radius of 0 only sets of equal fingerprints are linked
    assert len({x.doc_id for x in similar.one_of_similar(df, radius=0).collect()}) > len(want)


def test_repeated_ids_and_clashing_names(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a, "x"), (1, b, "y"), (1, b, "y"), (2, b + " more", "z"), (None, a, "w"), (None, None, "v"), (3, "", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, content string")
    got = [tuple(x) for x in similar.one_of_similar(df).collect()]
    assert sorted(got, key=str) == sorted([(1, a, "x"), (1, b, "y"), (3, "", "u")], key=str)
    assert similar.one_of_similar(df.limit(0)).count() == 0
