import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm.packing import pack_documents, plan
from ledgerloom.llm.tokens import default_path, tokenizer
from ledgerloom.llm.words import slices, split_words

ODD = ["", " ", "don't, 'LL'S x'ré", "é!! É… ÀÖß×÷a×b!", "á!́b <|endoftext|>A<|endoftext|>B", "İSTANBUL ΣΑΣ ǅ", "日本語。テスト１２3abc4", "x y z \x0b\x0c\r\n\tq",
       "a-b_c/d:e;f(g)h[i]{j}k~l`m^n@o#p$q%r&s*t+u=v?w\"x", "≮≯≠", "🙂👍🏽a🙂b!🙂", "A" * 5000, "!" * 3000, "KK ﬁ ﬀ"]


def texts(seed=5, n=200):
    r = random.Random(seed)
    alphabet = "aAbBzZ éÉüß'!.,<|>\n\t 09…×́ ſı日"
    return ODD + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(n)]


def whole(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path()).encode(text, add_special_tokens=False).ids


def test_ids_equal_whole_text_encoding():
    t = tokenizer(default_path())
    column = texts()
    flat, at = t.ids(pa.array([*column, None]))
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(default_path())
    for k, x in enumerate(column):
        assert flat[at[k] : at[k + 1]].tolist() == hf.encode(x, add_special_tokens=False).ids, x
    assert at[-1] == at[-2]
    assert t.counts(pa.array(column)).tolist() == np.diff(at)[:-1].tolist()


def test_split_words_is_bytes_split():
    column = texts(9)
    words, at = split_words(pa.array([*column, None]))
    for k, x in enumerate(column):
        assert words.slice(at[k], at[k + 1] - at[k]).to_pylist() == x.encode().split()
    batch = pa.record_batch([pa.array(range(len(column))), pa.array(column)], names=["i", "text"])
    assert [i for s in slices(batch, "text", 500) for i in s.column(0).to_pylist()] == list(range(len(column)))


@pytest.mark.parametrize("capacity", [16, 64])
def test_plan_covers_each_token_once(capacity):
    r = random.Random(capacity)
    for _ in range(50):
        lengths = np.array([r.choice([1, 3, capacity, r.randrange(1, 5 * capacity)]) for _ in range(r.randrange(1, 60))])
        seqs = plan(lengths, capacity)
        got = sorted((d, s + i) for seq in seqs for d, s, n in seq for i in range(n))
        assert got == [(d, i) for d, n in enumerate(lengths) for i in range(n)]
        sums = [sum(n for _, _, n in seq) for seq in seqs]
        assert all(0 < s <= capacity and (s == capacity or s & (s - 1) == 0) for s in sums)


def test_pack_rows(spark):
    column = [*texts(3, 40), None, "same text", "same text"]
    df = spark.createDataFrame([(k, x, 7, "s") for k, x in enumerate(column)], "doc_id long, text string, length long, sequence_id string")
    rows = pack_documents(df.repartition(3), capacity=64).collect()
    pieces = {}
    seqs = {}
    for x in rows:
        ids = [*(whole(column[x.doc_id]) if column[x.doc_id] else []), 2]
        assert x.doc_tokens == len(ids)
        own = ids[x.start : x.start + x.length]
        assert x.ids == own and zlib.crc32(np.array(own, "<u4").tobytes()) == x.ids_crc32
        pieces.setdefault(x.doc_id, []).append((x.start, x.length))
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert sorted(pieces) == list(range(len(column)))
    for k, v in pieces.items():
        assert sum(n for _, n in v) == len(whole(column[k] or "")) + 1
    for v in seqs.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 64
    assert pack_documents(df.limit(0)).count() == 0
