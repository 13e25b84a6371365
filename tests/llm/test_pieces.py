"""The prefix table against the library itself, on built texts and on whole documents."""

import hashlib
import random

import pyarrow as pa
import pytest

from ledgerloom.llm.pieces import SPACE, encode_documents, encoder, default_path
from ledgerloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", SPACE, f"a{SPACE}b", "\n", "a\nb\r\n\tc", "x" * 400, " " * 100, "<s></s><unk><0x41>", "é日本語🙂\x00☃", "0123 45", " a　b", "ab" * 3000]


@pytest.fixture(scope="module")
def coder():
    return encoder(default_path())


def texts(coder, n, seed):
    r = random.Random(seed)
    pieces = list(coder.table.merges)
    short = [p for p in pieces if len(p) <= 4]
    makers = [
        lambda: "".join(r.choice(pieces) for _ in range(r.randrange(1, 8))).replace(SPACE, r.choice([" ", SPACE])),
        lambda: "".join(r.choice(short) for _ in range(r.randrange(1, 12))),
        lambda: "".join(r.choice("ab tehin ▁\n\t0é日☃\x00😀aoes") for _ in range(r.randrange(40))),
        lambda: "".join(r.choice("  -=e*#\n") for _ in range(r.randrange(80))),
        lambda: "".join(chr(r.randrange(1, 0x3100)) for _ in range(r.randrange(30))),
    ]
    return ODD + [r.choice(makers)() for _ in range(n)]


def test_ids_equal_the_librarys(coder):
    xs = texts(coder, 20_000, 3)
    flat, at = coder.ids(pa.array([*xs, None]))
    want = coder.table.processor.encode(xs)
    for k, x in enumerate(xs):
        assert flat[at[k] : at[k + 1]].tolist() == want[k], x
    assert at[-1] == at[-2]


def test_every_prefix_has_its_last_token(coder):
    t = coder.table
    for x in texts(coder, 300, 4):
        s = SPACE + x.replace(" ", SPACE)
        last = t.last_tokens(s)
        for k in range(1, len(s) + 1):
            ids = t.processor.encode(s[1:k]) if k > 1 else t.processor.encode(" ")[:1]
            if last[k] >= 0 and k > 1:
                assert ids[-1] == last[k], (x, k)


def test_pairs_go_together_as_encoded_alone(coder):
    t, r = coder.table, random.Random(5)
    tokens = list(t.pieces)
    for _ in range(20_000):
        a, b = r.choice(tokens), r.choice(tokens)
        s = t.pieces[a] + t.pieces[b]
        if s.startswith(SPACE):  # the library adds this space itself
            assert t.together(a, b) == (t.processor.encode(s[1:]) == [a, b]), s


def test_memo_starts_afresh(coder, monkeypatch):
    from ledgerloom.llm import pieces

    monkeypatch.setattr(pieces, "MEMO_CHUNKS", 10)
    monkeypatch.setattr(pieces, "MEMO_PAIRS", 10)
    for x in texts(coder, 200, 6):
        flat, _ = coder.ids(pa.array([x]))
        assert flat.tolist() == coder.table.processor.encode(x)


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_rows(spark, coder):
    xs = [*texts(coder, 60, 7), None, "same", "same", "long text, " * 20_000]
    docs = spark.createDataFrame([(k, x, "old", 1) for k, x in enumerate(xs)] + [(None, "no id", None, None)], "doc_id long, text string, ids_sha256 string, _body int")
    got = encode_documents(docs.repartition(3))
    assert got.columns == ["doc_id", "text", "_body", "ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"]
    rows = got.collect()
    assert len(rows) == len(xs) + 1
    for x in rows:
        ids = [*coder.table.processor.encode(x.text or ""), 2]
        assert x.ids == ids and x.n_tokens == len(ids)
        assert x.ids_sha256 == digest(" ".join(map(str, ids)))
        assert x.decoded == coder.table.processor.decode(ids) and x.decoded_sha256 == digest(x.decoded)
        assert x.decoded == (x.text or "").replace(SPACE, " ")
    assert [r.n_tokens for r in encode_documents(docs.limit(1), end_id=None).collect()] == [0]
    assert encode_documents(docs.limit(0)).count() == 0


def test_query_is_the_librarys_result(spark, coder):
    sp = coder.table.processor
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = [*sp.encode(r.text or ""), 2]
        want.append((r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(sp.decode(ids))))
    got = QUERIES["op12_pieces"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert "text" not in QUERIES["op12_pieces"](spark, SF).columns
