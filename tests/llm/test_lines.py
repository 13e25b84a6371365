import random

from ledgerloom.llm.lines import dedup_lines, without_repeats



def norm(line):
    return line.strip(" \t\r\x0b\f").lower()


def grams(line):
    return {line[i : i + 12] for i in range(max(1, len(line) - 11))}


def brute(docs, threshold=0.8):
    lines = [(d is None, d or 0, i, p, norm(x)) for i, (d, t) in enumerate(docs) for p, x in enumerate((t or "").split("\n")) if norm(x)]
    lines.sort(key=lambda x: x[:4])
    texts = sorted({x[4] for x in lines})
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    index, seen, removed = {t: k for k, t in enumerate(texts)}, set(), {i: [] for i in range(len(docs))}
    for _, _, i, p, t in lines:
        c = find(index[t])
        if c in seen:
            removed[i].append(p)
        seen.add(c)
    return {i: sorted(v) for i, v in removed.items()}


def make(seed):
    r = random.Random(seed)
    words = [f"wörd{i}" for i in range(200)]
    base = [" ".join(r.choice(words) for _ in range(r.choice([1, 3, 8, 30, 60]))) for _ in range(40)]
    docs = []
    for d in r.sample(range(1000), 60):
        out = []
        for _ in range(r.randrange(6)):
            w = r.choice(base).split(" ")
            if r.random() < 0.6:
                w[r.randrange(len(w))] = r.choice(words)
            out.append(r.choice(["", " ", "\t"]) + " ".join(w).upper() if r.random() < 0.2 else " ".join(w))
            if r.random() < 0.2:
                out.append(r.choice(["", "  "]))
        docs.append((d, "\n".join(out)))
    return [*docs, (2000, None), (2001, ""), (None, docs[0][1]), (None, base[0]), (2002, "数据处理系统的设计与实现方法研究\n数据处理系统的设计与实现方法研究。"), (2003, "a\n\na"), (2003, "b"), (2004, "x" * 50_000), (2005, "Total items: 15\nTotal items: 16")]


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = make(seed)
        df = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, rid int, removed string").coalesce(1)
        want = brute(docs)
        rows = sorted(dedup_lines(df).collect(), key=lambda x: x.rid)
        got = {i: x.removed for i, x in enumerate(rows)}
        assert [x.doc_id for x in rows] == [d for d, _ in docs]
        wrong = [i for i in want if got[i] != want[i]]
        assert sum(len(v) for v in want.values()) > 60
        assert not wrong, [(docs[i], got[i], want[i]) for i in wrong[:3]]
        assert all(x.n_removed == len(x.removed) and x.n_lines == (len(t.split("\n")) if t else 0) for x, (_, t) in zip(rows, docs, strict=True))
        left = [t if not got[i] else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in got[i]) for i, (_, t) in enumerate(docs)]
        kept = [(k.doc_id, k.text, k.rid, k.removed) for k in without_repeats(df).collect()]
        assert sorted(kept, key=str) == sorted(((d, t, 1, "z") for (d, _), t in zip(docs, left, strict=True)), key=str)


def test_edges_of_the_input(spark):
    schema = "doc_id long, text string"
    assert dedup_lines(spark.createDataFrame([], schema)).count() == 0
    alone = dedup_lines(spark.createDataFrame([(1, "one\ntwo\n"), (2, " \n\n")], schema)).collect()
    assert sorted((x.doc_id, x.n_lines, x.n_removed) for x in alone) == [(1, 3, 0), (2, 3, 0)]
    same = dedup_lines(spark.createDataFrame([(1, "one"), (1, "one"), (2, "ONE ")], schema).coalesce(1)).collect()
    assert sorted((x.doc_id, x.n_removed) for x in same) == [(1, 0), (1, 1), (2, 1)]


def test_template_groups_against_brute_force(spark):
    r = random.Random(5)
    vocab = [[f"{name}{i:02d}" for i in range(n)] for name, n in (("region", 12), ("office", 12), ("status", 8), ("period", 10))]
    docs = []
    for d in range(400):
        a, b, c, e = (r.choice(v) for v in vocab)
        docs.append((d, f"the quarterly statement of {a} was sent by the {b} department with the final {c} mark for all of the accounts in {e} after review"))
    want = brute(docs)
    rows = sorted(dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect(), key=lambda x: x.rid)
    wanted = sum(len(v) for v in want.values())
    assert 20 < wanted < 390
    # banding misses a pair at the threshold with probability 0.002, and here most pairs are just above it
    assert sum(x.removed != want[i] for i, x in enumerate(rows)) <= 0.01 * len(docs)
    assert 0.99 * wanted <= sum(x.n_removed for x in rows) <= wanted


def family(r, n, edits, length):
    """n lines, each with some words of one line changed."""
    vocab = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    base = [r.choice(vocab) for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in r.sample(range(length), edits):
            w[at] = r.choice(vocab)
        out.append(" ".join(w))
    return out


def test_families_lose_no_link(spark):
    """Many lines a few words apart, of which no one line is like all others."""
    r = random.Random(11)
    docs = [(k, "\n".join(family(r, n, edits, r.randrange(30, 41)))) for k, (edits, n) in enumerate([(1, 60)] * 4 + [(2, 100)] * 4)]
    want = brute(docs)
    rows = sorted(dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect(), key=lambda x: x.rid)
    for own in (range(4), range(4, 8)):
        wanted, got = sum(len(want[i]) for i in own), sum(rows[i].n_removed for i in own)
        assert wanted > 0 and 0.99 * wanted <= got <= wanted, (wanted, got)


def test_blocks_of_a_bucket(spark, monkeypatch):
    """Buckets of several blocks on both sides give the same as one."""
    from ledgerloom.llm import lines

    r = random.Random(3)
    docs = [(k, x) for k, x in enumerate(family(r, 150, 2, 40))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    whole = sorted((x.doc_id, x.n_removed) for x in dedup_lines(df).collect())
    monkeypatch.setattr(lines, "BLOCK", 16)
    assert sorted((x.doc_id, x.n_removed) for x in dedup_lines(df).collect()) == whole
    assert sum(n for _, n in whole) > 0


def test_lines_of_a_template(spark, monkeypatch):
    """Lines that share most of their text and are not alike, among them some that are: no link is lost where they meet
    by their rarest shingles."""
    from ledgerloom.llm import lines

    r = random.Random(5)
    head = "".join(r.choice("abcdefgh ") for _ in range(150)).strip() + "x"
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    some = [head + word(80) for _ in range(120)]
    some += [x[:-3] + word(3) for x in some[:20]] + [x[: len(head) + 40] + word(40) for x in some[20:40]] + [x[:-4] + word(4) for x in some[120:130]]
    r.shuffle(some)
    docs = list(enumerate(some))
    want = brute(docs)
    monkeypatch.setattr(lines, "BLOCK", 8)
    met = []
    rare = lines.rare_shingles
    monkeypatch.setattr(lines, "rare_shingles", lambda *a: met.append(rare(*a)) or met[-1])
    got = {x.doc_id: x.n_removed for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == {k: len(v) for k, v in want.items()} and 20 <= sum(got.values()) < 60
    assert met and met[0].groupBy("b").count().agg({"count": "max"}).first()[0] < 40


def test_rows_dealt_otherwise_and_clashing_names(spark):
    r = random.Random(8)
    docs = [(d, "\n".join(family(r, 4, 1, 30))) for d in range(40)]
    docs += [docs[3], docs[3], (3, "another text of the same id"), (None, docs[5][1]), (None, docs[5][1])]
    df = spark.createDataFrame([(d, t, "a", "b", "c", "d") for d, t in docs], "doc_id long, text string, _rid string, _removed string, content string, number string")
    one, many = (without_repeats(x).collect() for x in (df.coalesce(1), df.repartition(7)))
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(one) == len(docs)
    kept = [x.text for x in one if x.doc_id == 3]
    assert sorted(map(bool, kept)) == [False, False, True, True]


def test_no_python_on_the_executors(spark, monkeypatch):
    """DataFrame operations alone, also for lines that repeat themselves (few different shingles), that hold characters
    outside the basic plane, or are shorter than a shingle."""
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(DataFrame, name, refuse)
    r = random.Random(4)
    long = "".join(r.choice("abcdefghij 😀é") for _ in range(300))
    some = ["ab" * 40, "ab" * 300, "abc " * 90 + "tail", "abc " * 30 + "tail", "the first words " + "xyz" * 100, "the first words " + "xyz" * 40]
    some += [long, long[:150] + "zz" + long[150:], long.replace("😀", "e"), long[:-5], "😀 b", "😀 B ", "😀 c", "one", "ONE\r"]
    docs = [(k, x) for k, x in enumerate(some)]
    want = brute(docs)
    got = {x.doc_id: x.removed for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect()}
    assert got == want and 5 <= sum(map(len, want.values())) < 12


def test_few_pairs_of_a_family_are_compared(spark, monkeypatch):
    """Near copies that are not all alike: what is compared exactly grows with the lines, not with their pairs, and is no
    less than what links them."""
    from ledgerloom.llm import lines

    r = random.Random(21)
    docs = [(k, x) for k, x in enumerate(family(r, 60, 1, 40) + family(r, 120, 2, 40))]
    want = brute(docs)
    compared = []
    decide = lines.similar_pairs
    monkeypatch.setattr(lines, "similar_pairs", lambda pairs, *a: compared.append(pairs.count()) or decide(pairs, *a))
    got = {x.doc_id: x.n_removed for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()}
    wanted = sum(map(len, want.values()))
    assert wanted > 60 and 0.98 * wanted <= sum(got.values()) <= wanted
    assert sum(compared) < 4 * len(docs), compared


def test_digests_rule_out_no_similar_pair(spark):
    """Of all pairs of lines, none that reaches the threshold; of those that are far below it, nearly all."""
    from ledgerloom.llm import lines
    from pyspark.sql import functions as F

    r = random.Random(22)
    some = family(r, 40, 1, 40) + family(r, 25, 6, 60) + ["ab" * 40, "ab" * 300, "abc " * 90 + "tail", "abc " * 30 + "tail", "😀 b" * 20, "😀 b" * 19 + "c", "x", "y"]
    nodes = spark.createDataFrame(list(enumerate(some)), "lid long, norm string").cache()
    pairs = nodes.select(F.col("lid").alias("u")).crossJoin(nodes.select(F.col("lid").alias("v"))).where("u < v")
    held = lines.digests(nodes)
    assert {x.lid: x.n for x in held.select("lid", "n").collect()} == {k: len(grams(x)) for k, x in enumerate(some)}
    left = {(x.u, x.v) for x in lines.near_pairs(pairs, held, 0.8).collect()}
    share = {(u, v): len(grams(some[u]) & grams(some[v])) / len(grams(some[u]) | grams(some[v])) for u in range(len(some)) for v in range(u + 1, len(some))}
    alike = {k for k, x in share.items() if x >= 0.8}
    assert 100 < len(alike) and alike <= left
    assert sum(k in left for k, x in share.items() if x < 0.7) < 10
    assert {(x.u, x.v) for x in lines.similar_pairs(pairs, nodes, 0.8).collect()} == alike
