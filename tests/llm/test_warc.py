import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.warc import assemble, base32_sha1, parse_archive, read_records, round_trip, write_captures


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows, min_bytes=0):
    groups = {}
    for i, _, p in rows:
        groups.setdefault((p or "").encode(), []).append(i)
    out = []
    for payload, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        for k, i in enumerate(ids):
            again = k > 0 and len(payload) >= min_bytes
            out.append((i, len(payload), digest(payload), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a.example/x?q#f", "<p>é\r\n\r\nWARC/1.1\r\n\r\n</p>"),
    (3, "https://b.example", "<p>é\r\n\r\nWARC/1.1\r\n\r\n</p>"),
    (9, None, None),
    (8, "bad\r\nX: y", ""),
    (1, "http://c.example/", "lone"),
    (1, "http://c.example/", "lone"),
    (None, "http://c.example/", "lone"),
    (None, None, "null id alone"),
    (7, "http://d.example/", "x" * 300_000),
]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, record_type string").repartition(3)
    got = round_trip(df, min_bytes=min_bytes, with_payload=True).collect()
    found = sorted([(r.page_id, r.capture.payload_bytes, r.capture.payload_digest, r.capture.record_type, r.refers_to_page) for r in got], key=str)
    assert found == expected(ROWS, min_bytes)
    for r in got:
        assert [m.record_type for m in r.metadata] == ["metadata"] and [q.record_type for q in r.requests] == ["request"]
        if r.capture.record_type == "response":
            assert digest(bytes(r.capture.payload)) == r.capture.payload_digest == r.capture.declared_digest.removeprefix("sha1:")
    assert round_trip(df.limit(0)).count() == 0


def test_base32(spark):
    for x in ["", "a", "é" * 100]:
        assert spark.range(1).select(base32_sha1(F.lit(x))).first()[0] == digest(x.encode())


def rec(kind, rid, block, *headers, ctype="application/http; msgtype=x"):
    h = [f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *headers, f"Content-Type: {ctype}", f"content-length: {len(block)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(h).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Members by record, concurrent-to on either side, metadata that names the request, folded headers, orphans."""
    http = b"HTTP/1.1 200 OK\r\nX: a\r\n b\r\n\r\n"
    records = [
        rec("warcinfo", "<i>", b"software: x\r\n", ctype="application/warc-fields"),
        rec("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n"),
        rec("response", "<r1>", http + b"body", "WARC-Concurrent-To: <q1>", "WARC-Concurrent-To: <m0>"),
        rec("metadata", "<m0>", b"k: v\r\n", ctype="application/warc-fields"),
        rec("metadata", "<m1>", b"k: w\r\n", "WARC-Concurrent-To: <q1>", ctype="application/warc-fields"),
        rec("response", "<r2>", http),
        rec("request", "<q9>", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <nowhere>"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    rows = {r.capture.record_id: r for r in assemble(read_records(spark, str(tmp_path))).collect()}
    assert set(rows) == {"<r1>", "<r2>"}
    assert [q.record_id for q in rows["<r1>"].requests] == ["<q1>"] and [m.record_id for m in rows["<r1>"].metadata] == ["<m0>", "<m1>"]
    assert bytes(rows["<r1>"].capture.payload) == b"body" and rows["<r2>"].capture.payload_bytes == 0
    assert rows["<r2>"].requests == [] and rows["<r2>"].metadata == []
    with pytest.raises(ValueError, match="ends within"):
        list(parse_archive(records[2][:-10]))
    with pytest.raises(ValueError, match="no WARC record"):
        list(parse_archive(b"hello"))
    assert list(parse_archive(b"")) == []


def test_plain_archives_are_standard(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    write_captures(df, str(tmp_path / "w"), compression="none")
    content = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert content.endswith(b"\r\n\r\n") and len(list(parse_archive(content))) == 3 * len(ROWS)


def test_oracle(spark):
    from ledgerloom.llm.queries import ORACLES, QUERIES
    from tests.llm.oracle import same

    same(spark, QUERIES["op1_warc"], ORACLES["op1_warc"], "/root/testdata/sf0.001")
