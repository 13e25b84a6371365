"""Cursor sources: every rule by a source that breaks it, retries and deadlines, and a stream that goes on where it stopped."""

import json

import pytest

from ledgerloom.sources import cursors as K
from ledgerloom.sources.paging import RemoteError

SIZES = {"d0": 0, "d1": 1, "d7": 7, "d20": 20}


def unit(k):
    return {"unit_id": f"u{k:04d}", "chunk_index": k // 3, "ordinal": k, "content": f"text {k}", "start_at": k, "end_at": k + 1}


def pages(document, cursor, size):
    """A good source: documents of SIZES, and no others."""
    if document not in SIZES:
        raise RemoteError(404)
    n, at = SIZES[document], int(cursor or 0)
    units = [unit(k) for k in range(at + 1, min(at + size, n) + 1)]
    more = at + size < n
    return {"success": True, "knowledge_id": document, "total_units": n, "units": units, "next_cursor": str(at + size) if more else None, "complete": not more}


def names(cursor, size):
    at = int(cursor or 0)
    return {"success": True, "data": [{"id": f"k{k}", "name": None} for k in range(at, min(at + size, 5))], "has_more": at + size < 5, "next_cursor": str(at + size)}


def container(key):
    if key == "gone":
        raise RemoteError(404)
    return {"success": True, "data": {"id": key}}


def versions(key):
    return {"success": True, "data": [{"id": f"{key}1"}, {"id": f"{key}2"}]}


def refused(document, cursor, size):
    raise RemoteError(403)


def torn(document, cursor, size):
    return {**pages("d20", cursor, size), "total_units": 20 if cursor is None else 21}


PAGE = {"knowledge_id": "d", "total_units": 2, "units": [unit(1), unit(2)], "next_cursor": None, "complete": True}
BAD = {
    "success": [{**PAGE, "success": False}],
    "same id": [{**PAGE, "knowledge_id": "e"}],
    "total": [{**PAGE, "total_units": -1}],
    "same total": [{**PAGE, "units": [unit(1)], "next_cursor": "c", "complete": False}, {**PAGE, "total_units": 3}],
    "units": [{**PAGE, "units": None}],
    "blank cursor": [{**PAGE, "next_cursor": " ", "complete": False}],
    "end": [{**PAGE, "next_cursor": "c"}],
    "missing cursor": [{**PAGE, "complete": False}],
    "no progress": [{**PAGE, "units": [], "next_cursor": "c", "complete": False}],
    "whole units": [{**PAGE, "units": [unit(1), {**unit(2), "content": None}]}],
    "unique units": [{**PAGE, "units": [unit(1), {**unit(2), "unit_id": "u0001"}]}],
    "ordinals": [{**PAGE, "units": [unit(1), unit(3)]}],
    "order": [{**PAGE, "units": [unit(1), {**unit(2), "unit_id": "a"}]}],
    "count": [{**PAGE, "total_units": 3}],
    "cursor loop": [{**PAGE, "total_units": 9, "units": [unit(1)], "next_cursor": "c", "complete": False}, {**PAGE, "total_units": 9, "units": [unit(2)], "next_cursor": "c", "complete": False}],
    "page cap": [{**PAGE, "total_units": 9, "units": [unit(k)], "next_cursor": str(k), "complete": False} for k in range(1, 9)],
}


@pytest.mark.parametrize("rule", BAD)
def test_each_rule(rule):
    answers = iter(BAD[rule])
    with pytest.raises(K.RuleError) as e:
        list(K.scan("d", K.Caller(lambda *a: next(answers)), 50, 5))
    assert e.value.rule == rule


def test_a_document_that_vanishes():
    answers = [{**PAGE, "units": [unit(1)], "next_cursor": "c", "complete": False}]

    def call(*a):
        if not answers:
            raise RemoteError(404)
        return answers.pop()

    with pytest.raises(K.RuleError, match="vanished"):
        list(K.scan("d", K.Caller(call)))
    assert list(K.scan("d", K.Caller(call))) == []


def test_retries_back_off_within_a_deadline():
    waits, now = [], [0.0]

    def sleep(s):
        waits.append(s)
        now[0] += s

    def failing(times, error):
        def call():
            if len(waits) < times:
                raise error
            return {"ok": True}
        return call

    make = lambda call, **o: K.Caller(call, sleep=sleep, clock=lambda: now[0], **o)
    assert make(failing(3, RemoteError(503)), attempts=4, pause=1)() == {"ok": True}
    assert len(waits) == 3 and 0.5 <= waits[0] <= 1 <= waits[1] <= 2 <= waits[2] <= 4
    waits.clear()
    with pytest.raises(K.RuleError, match="attempts"):
        make(failing(9, TimeoutError()), attempts=3, pause=1)()
    waits.clear()
    with pytest.raises(K.RuleError, match="deadline"):
        make(failing(9, ConnectionError()), attempts=9, pause=4, most=60, deadline=10)()
    assert sum(waits) <= 10
    for status in (400, 403, 404, 500):
        with pytest.raises(RemoteError):
            make(failing(9, RemoteError(status)))()


def test_lists_and_objects(spark):
    spark.dataSource.register(K.CursorPages)
    load = lambda kind, fetch, schema, **o: [tuple(r) for r in spark.read.format("cursor_pages").schema(schema).options(kind=kind, fetch=f"tests.test_cursors:{fetch}", **o).load().collect()]
    assert load("list", "names", "id string, name string", size="2") == [(f"k{k}", None) for k in range(5)]
    assert sorted(load("object", "container", "id string", keys='["a", "gone", "b"]')) == [("a",), ("b",)]
    assert sorted(load("array", "versions", "id string", keys='["a", "b"]')) == [("a1",), ("a2",), ("b1",), ("b2",)]
    for page, rule in (({"data": [], "has_more": True, "next_cursor": "x"}, "no progress"), ({"data": [1], "has_more": True}, "missing cursor"), ({"data": [1], "has_more": True, "next_cursor": "x"}, "cursor loop"), ({"data": {}}, "array")):
        with pytest.raises(K.RuleError, match=rule):
            list(K.listed(K.Caller(lambda *a, page=page: page)))


def want(*documents):
    return sorted((d, *(unit(k)[f] for f in K.FIELDS)) for d in documents for k in range(1, SIZES.get(d, 0) + 1))


def test_units(spark):
    spark.dataSource.register(K.CursorPages)
    df = spark.read.format("cursor_pages").options(fetch="tests.test_cursors:pages", documents=json.dumps([*SIZES, "none"]), size="3").load()
    assert sorted(map(tuple, df.collect())) == want(*SIZES) and df.rdd.getNumPartitions() == 5
    ids = spark.createDataFrame([(d,) for d in [*SIZES, "none", None, "d7"]], "document_id string").repartition(3)
    assert sorted(map(tuple, K.units_of(ids, "tests.test_cursors:pages", size=4).collect())) == want(*SIZES)
    for fetch, rule in (("torn", "same total"), ("refused", "403")):
        with pytest.raises(Exception, match=rule):
            K.units_of(ids.where("document_id = 'd20'"), f"tests.test_cursors:{fetch}", size=4).collect()


def test_stream_goes_on_from_its_offset(spark, tmp_path):
    spark.dataSource.register(K.CursorPages)

    def run(batches):
        df = spark.readStream.format("cursor_pages").options(fetch="tests.test_cursors:pages", documents=json.dumps(["d7", "d20", "none"]), size="3").load()
        q = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="100 milliseconds").start()
        try:
            for _ in range(400):
                q.awaitTermination(0.2)
                if q.lastProgress and q.lastProgress["batchId"] >= batches:
                    break
        finally:
            q.stop()
        assert q.exception() is None

    run(2)
    some = spark.read.parquet(f"{tmp_path}/out").count()
    run(9)
    got = sorted(map(tuple, spark.read.schema(K.UNITS).parquet(f"{tmp_path}/out").collect()))
    assert 0 < some <= 27 and got == want("d7", "d20")
