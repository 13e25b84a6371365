"""The manifest against a direct construction of the tree, its SQL, and proofs of tampered leaves."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.merkle import document_manifest, fold, levels, manifest, siblings
from ledgerloom.llm.queries import ORACLES, QUERIES
from oracle import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, at):
    """Top, and (others before, others after) at each level above node ``at``."""
    path = []
    while len(nodes) > 1:
        run = at // 3 * 3
        path.append((nodes[run:at], nodes[at + 1 : run + 3]))
        nodes, at = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)], at // 3
    return nodes[0], path


def brute(rows):
    groups = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        made = leaf(doc_id, source, lang, n_chars, text)
        odd = doc_id is None or text is None or zlib.crc32(str(doc_id).encode()) % 2
        found = made if odd else leaf(doc_id, source, lang, n_chars, text.replace("\n", ""))
        groups.setdefault(source, []).append(((doc_id is not None, doc_id), made, found))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort()
    tops = [climb([x[1] for x in groups[s]], 0)[0] for s in order]
    out = []
    for k, s in enumerate(order):
        for at, ((_, doc_id), made, found) in enumerate(groups[s]):
            subroot, low = climb([x[1] for x in groups[s]], at)
            root, high = climb(tops, k)
            node = found
            for a, b in [*low, *high]:
                node = h(*a, node, *b)
            out.append((doc_id, made, subroot, root, h(*(x for a, b in [*low, *high] for x in [*a, *b])), node, node == root))
    return sorted(out, key=str)


def random_rows(seed, sizes):
    r = random.Random(seed)
    rows = []
    for k, n in enumerate(sizes):
        source = [None, "", "é", "z", "Ω", "a"][k] if k < 6 else f"s{k}"
        for _ in range(n):
            text = r.choice([None, "", "one\ntwo", "\n", "plain", "é\n日本"])
            rows.append((r.choice([None, r.randrange(10**6)]), text, r.choice([None, "en"]), source, r.choice([None, 5]), "clash", 1))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("span", "sizes"), [(5, [1]), (1, [3, 4, 1, 9, 28]), (2, [2] * 11 + [100]), (5, [1, 1, 300])])
def test_equals_direct_construction(spark, span, sizes):
    rows = random_rows(len(sizes), sizes)
    rows += rows[:3]  # repeated rows
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = document_manifest(docs, span=span)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_vertex_functions():
    nodes = [h(str(k)) for k in range(28)]
    for at in range(28):
        rows = levels(nodes, 28, 99)
        top, _ = climb(nodes, at)
        assert rows[-1] == [top] and fold(nodes[at], siblings(rows, at)) == top
        assert fold(h("other"), siblings(rows, at)) != top
    assert levels(["x"], 1, 5) == [["x"]] and siblings([["x"]], 0) == []
    assert len(levels(nodes, 28, 2)) == 3


def test_empty_and_long(spark):
    docs = spark.createDataFrame([(1, "a\n" * 2_000_000, "en", "s", 4_000_000, "", 0), (2, "b", "en", "s", 1, "", 0)], SCHEMA)
    assert sorted(map(tuple, document_manifest(docs).collect()), key=str) == brute([tuple(r) for r in docs.collect()])
    assert document_manifest(docs.limit(0)).collect() == []


def test_untampered_proofs_hold(spark):
    docs = spark.createDataFrame(random_rows(8, [40, 5, 13]), SCHEMA)
    rows = manifest(docs, ["doc_id", "text"], group="source", order="doc_id", text="text").collect()
    assert all(r.verified for r in rows) and len({r.root for r in rows}) == 1
    rows = manifest(docs, ["doc_id", "text"], group="source", order="doc_id", text="text", tampered=F.lit("forged")).collect()
    assert not any(r.verified for r in rows)


def test_query_equals_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        same(spark, QUERIES["op13_merkle"], ORACLES["op13_merkle"], f"/root/testdata/{sf}")
