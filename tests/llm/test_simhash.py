import random

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import simhash
from ledgerloom.llm.simhash import BitPlanes, bit_majority, near_duplicates, shingle_hashes, small_groups


def plain_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and (a ^ b).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def near(r, fp, bits):
    for b in r.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def test_bit_majority():
    r = random.Random(1)
    sizes = [0, 1, 2, 3, 255, 256, 700, 0, 5, 0]
    hs = [[r.getrandbits(64) for _ in range(n)] for n in sizes]
    got = bit_majority(np.array([h for x in hs for h in x], np.uint64), np.array(sizes))
    want = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in x) > len(x)) for x in hs]
    assert got.tolist() == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_planes_and_small_groups(radius):
    r = random.Random(radius)
    fps = [r.getrandbits(64) for _ in range(20)]
    fps = np.array(fps + [near(r, r.choice(fps), r.randrange(7)) for _ in range(150)], np.uint64)
    p = BitPlanes(fps)
    bits = np.unpackbits(p.within(fps, radius).view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
    want = np.array([[(int(a) ^ int(b)).bit_count() <= radius for b in fps] for a in fps])
    assert (bits.astype(bool) == want).all()

    def classes(links, n):
        root = list(range(n))
        for a, b in links:
            root[a] = b
        return root

    forest = classes(p.forest(radius), len(fps))
    for i in range(len(fps)):
        for j in range(len(fps)):
            if want[i, j]:
                assert forest[i] == forest[j]
    sizes = np.array([64, 1, 40, 65 - 1, 1])
    flat, starts = np.concatenate([fps, fps])[: sizes.sum()], np.cumsum(sizes) - sizes
    got = small_groups(flat, starts, sizes, radius)
    for a, n in zip(starts, sizes, strict=True):
        inner = [(x - a, y - a) for x, y in got if a <= x < a + n]
        assert classes(inner, n) == classes(BitPlanes(flat[a : a + n]).forest(radius), n)


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    r = random.Random(3)
    vocab = [f"w{i}É" for i in range(50)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randrange(1, 400))) for _ in range(40)]
    texts = [*base, None, "", " \t\n", "one", "One  two", "ONE two three", *base[:5]]
    for _ in range(150):
        w = r.choice(base).split()
        w[r.randrange(len(w))] = "changed"
        texts.append("\n".join(w))
    rows = list(enumerate(texts))
    r.shuffle(rows)
    prints = [(i, plain_fp(t)) for i, t in rows]
    want = plain_components(prints)
    assert len(set(want.values())) < len(want) - 10
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, component_id int")
    for limit in (simhash.REFINE_ABOVE, 3):
        monkeypatch.setattr(simhash, "REFINE_ABOVE", limit)
        got = near_duplicates(df).collect()
        assert {x.doc_id: x.fp & (2**64 - 1) for x in got} == dict(prints)
        assert {x.doc_id: x.component_id for x in got} == want
        assert len(got) == len(rows)


def test_edges_of_the_input(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = near_duplicates(spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, "q w e r t")], schema)).collect()
    assert sorted((str(x.doc_id), str(x.component_id)) for x in rows) == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert len(shingle_hashes(b"A" * 100_000 + b" b c d", 3, 42)) == 2
