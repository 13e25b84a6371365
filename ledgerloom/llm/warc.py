"""WARC archives: writing captures, reading records, and assembling the records of each capture.

Archives are written by Spark's text writer with CR LF CR LF, the end of a WARC record, as separator,
so that any file system Spark reaches will do and a task that is tried again leaves no torn file. They
are read as whole files and parsed by Content-Length. Files hold RECORDS_PER_FILE records at most.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import cut, shared_dir, written

RECORDS_PER_FILE = 3000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URI = "about:blank"
CAPTURES = ("response", "revisit")

_S, _L = T.StringType(), T.LongType()
RECORD = T.StructType(
    [
        *(T.StructField(c, _S) for c in ("record_id", "record_type", "date", "target_uri", "refers_to", "refers_to_uri", "profile", "content_type", "declared_digest")),
        T.StructField("concurrent_to", T.ArrayType(_S)),
        T.StructField("payload_digest", _S),
        T.StructField("payload_bytes", _L),
        T.StructField("http_header", _S),
        T.StructField("fields", T.MapType(_S, _S)),
        T.StructField("payload", T.BinaryType()),
    ]
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base 32 of SHA-1: ten hexadecimal digits are eight digits of base 32."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(kind: str, page_id: Column, row: Column, number: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(kind), page_id.cast("string"), row.cast("string"), number.cast("string")))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(headers: list[tuple[str, Column | str | None]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1")]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.concat(F.lit(f"{name}: "), value))  # a null value leaves the line out
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def write_captures(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    compression: str = "gzip",
) -> None:
    """Writes a request, a response or revisit, and a metadata record for each row of ``pages``.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one with the smallest id becomes the
    response (a null id counts as largest; among repeated ids, that of the least hash of id, URL and payload, and of rows
    that agree in all three, any one) and the others revisit it. No row is numbered by the place where it is read,
    which may differ when a task runs again; rows that agree in all three are numbered in a table of their own. A null payload is empty. A null URL is written as about:blank; line breaks in URLs are escaped.
    Payloads cross the network once, to meet the digest's first row; a digest that very many rows share is
    one key of an equi-join, which adaptive execution splits.
    """
    uri = F.regexp_replace(F.regexp_replace(pages[url_col].cast("string"), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(pages[id_col].alias("id"), F.coalesce(uri, F.lit(NO_URI)).alias("uri"), F.coalesce(pages[payload_col], F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload")).withColumn("row", F.xxhash64("id", "uri", "digest"))
    narrow = written(rows.drop("payload"), "digests")
    again = cut(narrow.groupBy("row").agg(F.count("*").alias("c")).where("c > 1").select("row"))
    rows, narrow = (x.withColumn("n", F.lit(0).cast("long")) for x in (rows, narrow))
    if not again.isEmpty():
        several = written(rows.join(again, "row", "left_semi").withColumn("n", F.monotonically_increasing_id()), "several")
        rows, narrow = (x.join(again, "row", "left_anti").select(x.columns).unionByName(several.select(x.columns)) for x in (rows, narrow))
    lead = narrow.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "n", "uri")).alias("lead"))
    lead = cut(lead)  # a table of its own, so that both sides of the join are dealt out for it
    rows = rows.join(lead, "digest", "left")
    revisit = F.col("lead").isNotNull() & (F.col("bytes") >= min_bytes) & ((F.col("row") != F.col("lead.row")) | (F.col("n") != F.col("lead.n")))
    own = {k: _uuid(k, F.col("id"), F.col("row"), F.col("n")) for k in ("request", "response", "metadata")}
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("uri"))]
    host, target = F.regexp_extract("uri", r"^\w+://([^/?#]*)", 1), F.regexp_replace("uri", r"^\w+://[^/?#]*|#.*$", "")
    get = F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    concurrent = ("WARC-Concurrent-To", own["response"])
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", own["request"]), *common, concurrent, ("Content-Type", "application/http; msgtype=request")], get)
    response = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", own["response"]),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(revisit, _uuid("response", F.col("lead.id"), F.col("lead.row"), F.col("lead.n")))),
            ("WARC-Refers-To-Target-URI", F.when(revisit, F.col("lead.uri"))),
            ("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
            ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        F.when(revisit, http).otherwise(F.concat(http, "payload")),
    )
    about = F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit(""))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", own["metadata"]), *common, concurrent, ("Content-Type", "application/warc-fields")], about)
    out = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    writer = out.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE)
    (writer.option("compression", compression) if compression != "none" else writer).text(path)


def _headers(f: io.BufferedIOBase) -> tuple[list[tuple[str, str]], str]:
    """Named fields up to the empty line, folded lines joined, and the lines as they are."""
    out: list[tuple[str, str]] = []
    raw = []
    while line := f.readline():
        if line in (b"\r\n", b"\n"):
            break
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        raw.append(text)
        if text[:1] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        else:
            name, _, value = text.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out, "\r\n".join(raw)


def parse_archive(content: bytes, with_payload: bool = True, name: str = "archive") -> Iterator[dict]:
    """The records of one archive, plain or gzip (as a whole or by record). A torn archive is an error."""
    plain = io.BytesIO(content)
    f = io.BufferedReader(gzip.GzipFile(fileobj=plain), 1 << 16) if content[:2] == b"\x1f\x8b" else plain
    while version := f.readline():
        if version in (b"\r\n", b"\n"):
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC record where one should begin: {version[:40]!r}")
        pairs, _ = _headers(f)
        h = dict(reversed(pairs))
        size = int(h.get("content-length", ""))
        block = f.read(size)
        if len(block) != size:
            raise ValueError(f"{name}: the archive ends within record {h.get('warc-record-id')}")
        kind, content_type = h.get("warc-type", "").lower(), h.get("content-type", "")
        declared = h.get("warc-payload-digest")
        r = {
            "record_id": h.get("warc-record-id"),
            "record_type": kind,
            "date": h.get("warc-date"),
            "target_uri": h.get("warc-target-uri"),
            "refers_to": h.get("warc-refers-to"),
            "refers_to_uri": h.get("warc-refers-to-target-uri"),
            "profile": h.get("warc-profile"),
            "content_type": content_type,
            "declared_digest": declared,
            "concurrent_to": [v for k, v in pairs if k == "warc-concurrent-to"],
            "payload_digest": None,
            "payload_bytes": None,
            "http_header": None,
            "fields": None,
            "payload": None,
        }
        if content_type.startswith("application/http"):
            body = io.BytesIO(block)
            fields, r["http_header"] = _headers(body)
            payload = block[body.tell() :]
            if kind == "revisit":  # the payload is elsewhere; the headers tell its size and digest
                length = dict(fields).get("content-length", "")
                r["payload_bytes"] = int(length) if length.isdigit() else None
                r["payload_digest"] = declared.removeprefix("sha1:") if declared else None
                payload = None
        else:
            payload = block
            if content_type.startswith("application/warc-fields"):
                r["fields"] = dict(_headers(io.BytesIO(block))[0])
        if payload is not None:
            r["payload_bytes"] = len(payload)
            r["payload_digest"] = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
            r["payload"] = payload if with_payload else None
        yield r


def read_records(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives below ``path``; without payloads, only their digests and sizes."""
    kinds = {
        "string": pa.string(),
        "bigint": pa.int64(),
        "array<string>": pa.list_(pa.string()),
        "map<string,string>": pa.map_(pa.string(), pa.string()),
        "binary": pa.binary(),
    }
    schema = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in RECORD])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size = [], 0
                for r in parse_archive(content.as_py(), with_payload, name):
                    held.append(r | {"fields": list(r["fields"].items()) if r["fields"] is not None else None})
                    size += len(r["payload"] or b"") + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture (the response or revisit), requests and metadata (arrays).

    Request and metadata records join a capture through concurrent-to identifiers, named by either side,
    or through a record that so joins it (metadata that names the request). Arrays are in the order of
    record ids and empty where a capture has none. A record that reaches several captures is in each; one
    that reaches none, or has a null id, makes no row. Captures themselves are never dropped. ``records``
    is read several times, so it should be a table; only ids move until the last joins.
    """
    kind = F.col("record_type")
    captures, others = records.where(kind.isin(*CAPTURES)), records.where(kind.isin("request", "metadata"))
    stated = records.where(kind.isin(*CAPTURES, "request", "metadata")).select("record_id", F.explode("concurrent_to").alias("to"))
    both = stated.unionByName(stated.select(F.col("to").alias("record_id"), F.col("record_id").alias("to")))
    ids = captures.select(F.col("record_id").alias("to"))
    direct = both.join(ids, "to", "left_semi").select("record_id", F.col("to").alias("capture_id"))
    via = both.join(direct.withColumnRenamed("record_id", "to"), "to").select("record_id", "capture_id")
    members = direct.unionByName(via).distinct()
    kept = [c for c in records.columns if c not in ("concurrent_to", "refers_to", "refers_to_uri", "profile")]
    grouped = (
        others.join(members, "record_id")
        .groupBy("capture_id")
        .pivot("record_type", ["request", "metadata"])
        .agg(F.array_sort(F.collect_list(F.struct("record_id", *(c for c in kept if c not in ("record_id", "fields", "payload")), F.map_entries("fields").alias("fields"), *(["payload"] if "payload" in kept else [])))))
    )
    capture = captures.select("record_id", F.struct(*records.columns).alias("capture"))
    out = capture.join(grouped, capture["record_id"] == grouped["capture_id"], "left")
    empty = lambda c: F.coalesce(c, F.array().cast(grouped.schema[c].dataType))
    return out.select("capture", empty("request").alias("requests"), empty("metadata").alias("metadata"))


def round_trip(pages: DataFrame, *, min_bytes: int = 0, with_payload: bool = False, **columns: str) -> DataFrame:
    """Writes the captures of ``pages`` to archives in the shared folder, reads them back and assembles them.

    Adds page_id, from the metadata records, and refers_to_page, the id of the page whose response a
    revisit names. All cases of ``write_captures`` hold: null payloads are empty, null ids come back null,
    repeated rows are captures of their own, other columns are ignored, no rows give no rows.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_captures(pages, path, min_bytes=min_bytes, **columns)
    kind = pages.schema[columns.get("id_col", "page_id")].dataType
    records = written(read_records(spark, path, with_payload=with_payload), "records")
    own = F.filter(F.flatten(F.transform("metadata", lambda m: m["fields"])), lambda e: e["key"] == "page-id")
    whole = written(assemble(records).withColumn("page_id", F.get(own, F.lit(0))["value"].cast(kind)), "captures")
    named = whole.select(F.col("capture.record_id").alias("_to"), F.col("page_id").alias("refers_to_page"))
    return whole.join(named, F.col("capture.refers_to") == F.col("_to"), "left").drop("_to")
