"""Folding of event streams with tool calls: frames, classification, and both folds against a plain sequential one."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import calls as C

KINDS = "stream_id string, seq bigint, kind string, content string, call_id string, success boolean"


def tool(kind, **data):
    return json.dumps({"response_type": kind, "data": data})


def result(success, **data):
    return json.dumps({"response_type": "tool_result", "data": {"success": success, "tool_name": "read_skill", **data}})


CASES = [
    ("message", '{"response_type":"answer","content":"hi"}', "answer", "hi", None, False),
    ("message", '{"response_type":"answer"}', "answer", "", None, False),
    ("message", '{"response_type":"complete","done":true}', "complete", "", None, False),
    ("message", '{"response_type":"complete","done":false}', "other", "", None, False),
    ("message", '{"response_type":"error","done":true,"message":"m"}', "error", "", None, False),
    ("message", '{"response_type":"error"}', "other", "", None, False),
    ("ping", '{"response_type":"answer"}', "not a message", "", None, False),
    (None, '{"response_type":"answer"}', "not a message", "", None, False),
    ("message", None, "oversized event", "", None, False),
    ("message", '{"response_type":"answer","content":"' + "x" * 500 + '"}', "oversized event", "", None, False),
    ("message", "{broken", "not json", "", None, False),
    ("message", '{"content":"x"}', "no type", "", None, False),
    ("message", '{"response_type":" "}', "no type", "", None, False),
    ("message", tool("tool_call", tool_name="read_skill", tool_call_id="a"), "declared", "", "a", False),
    ("message", tool("tool_call", tool_name="read_skill", call_id="a", arguments={"skill_name": "s"}), "call", "", "a", False),
    ("message", tool("tool_call", tool_name="read_skill", id="a", skill_name="s"), "call", "", "a", False),
    ("message", tool("tool_call", tool_name="read_skill", id="a", skill_name="t"), "other skill", "", None, False),
    ("message", tool("tool_call", tool_name="read_skill"), "unidentified call", "", None, False),
    ("message", tool("tool_call", tool_name="read_skill", skill_name="s", id=" "), "unidentified call", "", None, False),
    ("message", tool("tool_call", tool_name="execute_skill_script"), "other", "", None, False),
    ("message", tool("tool_call", tool_name="shell"), "forbidden tool", "", None, False),
    ("message", tool("tool_call"), "forbidden tool", "", None, False),
    ("message", result(True, id="a"), "result", "", "a", True),
    ("message", result(False, id="a", skill_name="s"), "result", "", "a", False),
    ("message", result(True, id="a", skill_name="t"), "other", "", None, False),
    ("message", result(True), "other", "", None, False),
    ("message", tool("tool_result", tool_name="shell", id="a"), "forbidden tool", "", None, False),
    ("message", '{"response_type":"thought"}', "other", "", None, False),
]


def test_classify(spark):
    rows = [(k, 1, e, d, "kept") for k, (e, d, *_) in enumerate(CASES)]
    events = spark.createDataFrame(rows, "stream_id int, seq bigint, event string, data string, content string")
    got = {r.stream_id: tuple(r)[2:] for r in C.classify(events, skill="s", max_characters=300).collect()}
    for k, (*_, kind, content, call_id, success) in enumerate(CASES):
        assert got[k] == (kind, content, call_id, success), CASES[k]
    strict = {r.stream_id: r.kind for r in C.classify(events, skill="s", max_characters=300, preparation=True).collect()}
    assert [strict[k] for k in (5, 19, 23, 24)] == ["error", "forbidden tool", "failed result", "other skill"]


def test_frames(spark):
    body = "event: message\ndata: {\"a\":\ndata: 1}\n\n: comment\n\ndata:x\r\n\r\nid: 7\nevent: ping\ndata: y\n"
    rows = spark.createDataFrame([("s", body), ("n", None), ("e", "")], "stream_id string, body string")
    got = C.frames(rows).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [("s", 1, "message", '{"a":\n1}'), ("s", 2, "message", "x"), ("s", 3, "ping", "y")]


def brute(events, limit, evidence):
    """One stream, event by event."""
    by = {}
    for seq, *e in events:
        by[seq] = min(by.get(seq, tuple(e)), tuple(e))
    text, declared, call, answered, good, bad, unknown, at = "", set(), None, False, False, False, 0, 1
    while at in by:
        kind, content, call_id, success = by[at]
        at += 1
        if kind == "complete":
            opened, pending = len(declared), int(call is not None and not answered)
            status = "complete" if not evidence else "open declaration" if opened else "open call" if pending else "failed call" if bad else "complete" if good else "no evidence"
            return (text if status == "complete" else None, status, opened, pending, unknown)
        if kind in C.REFUSED or kind == "call" and call:
            return (None, "repeated call" if kind == "call" else kind, None, None, None)
        text += content
        if len(text) > limit:
            return (None, "oversized answer", None, None, None)
        if kind == "declared":
            declared.add(call_id)
        elif kind == "call":
            call = call_id
            declared.discard(call_id)
        elif kind == "result":
            if call_id == call and not answered:
                answered, good, bad = True, success, not success
            else:
                unknown += 1
    return (None, "torn" if max(by) >= at else "unterminated", None, None, None)


def random_events(seed, streams=80):
    r = random.Random(seed)
    out = []
    for s in range(streams):
        n = r.randrange(1, 14)
        rows = []
        for seq in range(1, n + 1):
            kind = r.choice(["answer", "answer", "declared", "call", "result", "result", "other", "complete" if seq > n // 2 else "answer", r.choice(["error", "answer", "answer", "answer"])])
            rows.append((f"s{s}", seq, kind, r.choice(["", "ab", "long text"]) if kind == "answer" else "", r.choice("xy") if kind in ("declared", "call", "result") else None, kind == "result" and r.random() < 0.7))
        if r.random() < 0.3 and n > 2:
            rows.pop(r.randrange(n - 1))
        rows += r.sample(rows, r.randrange(0, 2))  # delivered again
        out += rows
    r.shuffle(out)
    return out


@pytest.mark.parametrize("evidence", [False, True])
def test_fold_equals_sequential(spark, evidence):
    rows = random_events(1 + evidence, 300)
    want = {s: brute([x[1:] for x in rows if x[0] == s], 18, evidence) for s in {x[0] for x in rows}}
    got = C.fold(spark.createDataFrame(rows, KINDS), limit=18, evidence=evidence)
    assert got.columns == ["stream_id", "answer", "status", "open_declarations", "open_calls", "unknown_results"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert {"complete", "torn", "unterminated", "error", "repeated call", "oversized answer"} <= {v[1] for v in want.values()}
    assert C.fold(spark.createDataFrame([], KINDS)).count() == 0


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    C.use_state_store(spark)
    rows = random_events(5)
    end = [("flush", 1, "complete", "", None, False)]
    for k in range(4):
        part = [(*x, f"2024-01-01 00:00:{k:02d}") for x in rows[k::4]] or []
        spark.createDataFrame(part, f"{KINDS}, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    # much later events move the watermark on, so that silent streams are told
    for k in (8, 9):
        spark.createDataFrame([(*end[0], f"2024-01-0{k} 00:00:00")], f"{KINDS}, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(f"{KINDS}, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = C.fold_stream(stream, limit=18, evidence=True, silence_ms=3_600_000, late="1 hour").writeStream.format("memory").queryName("calls_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted(tuple(r) for r in spark.table("calls_out").where("stream_id <> 'flush'").collect())
    assert got == sorted(tuple(r) for r in C.fold(spark.createDataFrame(rows, KINDS), limit=18, evidence=True).collect())


def test_fold_deals_events_out_once(spark, capsys):
    C.fold(spark.createDataFrame([], KINDS), evidence=True).explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def test_fold_of_odd_numbers(spark):
    """Numbers below 1 and nulls count for nothing, and repeats in between tear no stream."""
    rows = [("z", 0, "complete", "", None, False), ("n", None, "answer", "x", None, False), ("a", -3, "call", "", "c", False), ("a", 1, "answer", "x", None, False), ("a", 1, "answer", "x", None, False), ("a", 2, "complete", "", None, False), ("g", 2, "complete", "", None, False)]
    got = {r.stream_id: (r.answer, r.status) for r in C.fold(spark.createDataFrame(rows, "stream_id string, seq long, kind string, content string, call_id string, success boolean")).collect()}
    assert got == {"z": (None, "unterminated"), "n": (None, "unterminated"), "a": ("x", "complete"), "g": (None, "torn")}
