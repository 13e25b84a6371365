"""Known answers of the contract-checked parts: text functions, Markdown, freezing, acceptance, progress, paging, workbook."""

import hashlib
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import ids as I
from ledgerloom.functions import text as X
from ledgerloom.operators import ledger as L
from ledgerloom.plans import progress as P
from ledgerloom.plans import review as R
from ledgerloom.sinks.xlsx import read_workbook, write_workbook
from ledgerloom.sources import markdown as M
from ledgerloom.sources import paging
from ledgerloom.streaming import answers

AUDIT = "## 需求与功能清单审查发现\n\n| 序号 | 对象/功能点 | 问题分类 | 证据对照 |\n| --- | --- | :---: | --- |\n"
CASES = "\n## 测试用例\n\n| 用例名称 | 功能模块 | 前提约束 | 执行步骤 | 预期结果 | 对应需求内容 |\n|---|---|---|---|---|---|\n"
CASE = "| a | b | c | d | e | f |\n"


def one(spark, expr, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "value, want",
    [
        ("key sk-abcdefgh1 end", "key <redacted> end"),
        ("Password: hunter2, x", "Password:<redacted>, x"),
        ("see https://h.example/p?q and C:\\a\\b", "see <external-url> and <internal-path>"),
        ("in /var/log/app.txt now", "in <internal-path> now"),
        ("a/b c/d", "a/b c/d"),
        ("  ", X.REDACTED_BLANK),
        (None, X.REDACTED_BLANK),
    ],
)
def test_redact(spark, value, want):
    assert one(spark, X.redact(F.col("v").cast("string")), v=value) == want


def test_text_functions(spark):
    c = F.col("v")
    assert one(spark, X.normal_path(c), v="　订单 /\tＡＢﬁ　") == "订单 / abfi"
    assert one(spark, X.strip(c), v="　x　\n") == "x"
    assert one(spark, X.token(c, "a"), v="b=1; a=2") == "2"
    assert [one(spark, X.token(c, "a"), v=v) for v in ("a=1;a=2", "a=", "b=1", "a=1=2")] == [None] * 4
    assert one(spark, X.candidate_ids(c), v="x; candidateIds=p,q; y") == ["p", "q"]
    assert [one(spark, X.candidate_ids(c), v=v) for v in ("candidateIds=p,p", "candidateIds=p;candidateIds=q", "none", "candidateIds=p,,q")] == [None] * 4
    d, u = F.lit("d1"), F.lit("u1")
    assert one(spark, X.coordinates_are(c, d, u), v="documentId=d1; unitId=u1; more") is True
    assert [one(spark, X.coordinates_are(c, d, u), v=v) for v in ("documentId=d1", "documentId=d1;unitId=u1;unitId=u1", "documentId=d2;unitId=u1", "documentId=d1 ;unitId=u 1")] == [False] * 4
    assert one(spark, X.rebind(c, F.lit("D"), F.lit("U")), v="documentId=d1; unitId=u1; page 3") == "documentId=D; unitId=U; page 3"
    assert one(spark, X.markdown_cells(c), v=r"| a \| b | c<br/>d<BR> |  |") == ["a | b", "c\nd", ""]
    assert one(spark, X.markdown_cells(c), v="no row") is None
    assert one(spark, X.numbered_from_one(c), v="1. a\n2.  b") is True
    assert [one(spark, X.numbered_from_one(c), v=v) for v in ("1. a\n3. b", "a", "1. a\n\n2. b", "2. a")] == [False] * 4
    assert one(spark, X.length_prefixed(c), v="😀a") == "3:😀a" and one(spark, X.length_prefixed(c.cast("string")), v=None) == "-1:"
    assert one(spark, X.leaf(c), v="a/ b ") == "b" and one(spark, X.one_line(c), v="a\r\nb|c") == "a  b¦c"
    assert [one(spark, X.guard_formula(c), v=v) for v in ("=1", "+1", "-1", "@x", "1=")] == ["'=1", "'+1", "'-1", "'@x", "1="]
    assert one(spark, I.sha_id(c, F.lit("b")), v="a") == hashlib.sha256(b"a\x1fb").hexdigest()
    for name in ("", "x", "订单:1"):
        assert one(spark, I.name_uuid(c), v=name) == str(uuid.UUID(bytes=hashlib.md5(name.encode()).digest(), version=3))


def test_markdown_generation():
    text = AUDIT + "| 1 | o \\| p | k | e<br />f |\n" + CASES + CASE
    audit, cases = M.parse(text, "generation")
    assert audit == [(1, 1, "o | p", "k", "e\nf")] and cases == [(1, "a", "b", "c", "d", "e", "f")]
    broken = [None, " ", "{}", text + "```", text + "tail", text.replace("序号", "号"), AUDIT + CASES, text.replace("| 1 |", "| 0 |"), text.replace("| a |", "| |"), text + "![x]", text.replace("o \\|", "<b>o"), text.replace(CASE, "| a |\n"), AUDIT, text.replace("| 1 |", '| {"a": 1} |')]
    for b in broken:
        with pytest.raises(M.Rejected):
            M.parse(b, "generation")


def test_markdown_scan_and_conclusions(spark):
    rows = "| 1 | x<br>y | 拆分 | candidateIds=a,b |\n| 2 | z | 匹配 | q; candidateIds=c |\n"
    assert M.parse(AUDIT + rows + CASES, "scan")[0][0] == (1, 1, "x<br>y", "拆分", "candidateIds=a,b")
    assert len(M.parse(AUDIT + rows + CASES, "conclusion")[0]) == 2 and M.parse(AUDIT + CASES, "scan") == ([], [])
    for bad in (rows.replace("=c", "=a"), rows.replace("匹配", "?"), rows.replace("| 2 |", "| 1 |"), rows.replace("candidateIds=c", "c")):
        with pytest.raises(M.Rejected):
            M.parse(AUDIT + bad + CASES, "conclusion")
    with pytest.raises(M.Rejected):
        M.parse(AUDIT + rows + CASES + CASE, "scan")
    df = spark.createDataFrame([(1, AUDIT + rows + CASES), (2, "junk"), (3, None)], "id int, markdown string")
    out = {r.id: r for r in M.read(df, "conclusion").collect()}
    assert [len(out[k].audit) for k in (1, 2, 3)] == [2, 0, 0] and out[1].error is None and out[2].error and out[3].error
    assert out[1].audit[1].category == "匹配" and M.CATEGORIES["匹配"] == "MATCHED"


def ledger(spark):
    """30 list rows, of which two are the same and one is a split, and 2 requirement rows: 31 conclusions, 32 targets."""
    candidates = [("t", f"c{k:02d}") for k in range(32)]
    conclusions = [("t", "k01", "MERGE", "功能 1", ["c01", "c02"]), ("t", "k03", "SPLIT", "功能 3/a<br>功能 3/b", ["c03"])]
    conclusions += [("t", f"k{k:02d}", "MATCHED", f"功能 {k}", [f"c{k:02d}"]) for k in range(32) if k not in (1, 2, 3)]
    return spark.createDataFrame(candidates, "task_id string, occurrence_id string"), spark.createDataFrame(conclusions, "task_id string, id string, conclusion_type string, explanation string, candidate_ids array<string>")


def test_freeze_golden(spark):
    candidates, conclusions = ledger(spark)
    targets, violations = R.freeze(candidates, conclusions)
    assert (candidates.count(), conclusions.count(), targets.count(), violations.count()) == (32, 31, 32, 0)
    rows = targets.orderBy("stable_sequence").collect()
    assert [r.stable_sequence for r in rows] == list(range(1, 33)) and sorted(r.stable_feature_id for r in rows) == [r.stable_feature_id for r in rows]
    merged = next(r for r in rows if r.feature_name == "功能 1")
    assert merged.stable_feature_id == "ff-" + hashlib.sha256("c01\x1fc02\x1f功能 1".encode()).hexdigest()
    assert R.freeze(candidates, conclusions.repartition(5))[0].orderBy("stable_sequence").collect() == rows
    batches = R.plan_batches(targets)
    assert batches.count() == 32 and batches.count() * 2 == 64
    conflict = conclusions.withColumn("conclusion_type", F.when(F.col("id") == "k09", "CONFLICT").otherwise(F.col("conclusion_type")))
    assert [r.rule for r in R.freeze(candidates, conflict)[1].collect()] == ["conflict"]
    lost = R.freeze(candidates, conclusions.where("id <> 'k05'"))[1].collect()
    assert [(r.rule, r.key, r.detail) for r in lost] == [("one conclusion", "t|c05", "missing")]
    twice = R.freeze(candidates, conclusions.withColumn("explanation", F.when(F.col("id") == "k05", " 功能　6").otherwise(F.col("explanation"))))[1].collect()
    assert [r.rule for r in twice] == ["distinct path"]
    for text, error in (("a<br>b", "only a split"), (" ", "blank"), ("<b>x", "markup")):
        bad = conclusions.withColumn("explanation", F.when(F.col("id") == "k05", text).otherwise(F.col("explanation")))
        assert any(error in (r.detail or "") for r in R.freeze(candidates, bad)[1].collect())


def test_second_pass(spark):
    schema = "task_id string, document_id string, unit_id string, feature_text string, category string, evidence_text string"
    a, b = ("t", "d", "u", "A", "k", "e"), ("t", "d", "u", "B", "k", "e")
    out = R.second_pass(spark.createDataFrame([a, a], schema), spark.createDataFrame([a, b], schema)).collect()
    assert {r.feature_text: r.is_new for r in out} == {"A": False, "B": True} and len(out) == 2


def test_acceptance(spark):
    targets = spark.createDataFrame([(1, "订单管理/订单查询", True, ["candidate-a", "candidate-b"])], "batch_id int, feature_name string, generation_eligible boolean, candidate_ids array<string>")
    audit = "batch_id int, subject string, evidence string"
    case = "batch_id int, case_name string, feature_module string, execution_steps string, expected_result string, requirement_content string"
    good = [(1, f"订单查询_{k}", "订单管理/订单查询", "1. a\n2. b", "1. c\n2. d", need) for k, need in (("正向", "candidateIds=candidate-a"), ("反向", R.GENERAL))]
    row = (1, "订单查询", "x; candidateIds=candidate-b")

    def rules(cases, audits=(row,), t=targets):
        return {r.rule for r in R.refused_batches(t, spark.createDataFrame(list(audits), audit), spark.createDataFrame(list(cases), case)).collect()}

    change = lambda k, v: [good[0], tuple(v if i == k else x for i, x in enumerate(good[1]))]
    assert rules(good) == set()
    assert rules(good[:1]) == {"two cases", "names"}
    assert rules(change(1, "其他_反向")) == {"names"} and rules(change(2, "订单管理")) == {"module"}
    assert rules(change(3, "1. a")) == {"numbering"} and rules(change(4, "1. c\n3. d")) == {"numbering"}
    assert rules(change(5, "candidateIds=other")) == {"requirement"} and rules(change(5, "依据通用经验")) == {"requirement"}
    assert rules(good, [(1, "别的", "candidateIds=candidate-a")]) == {"subject"} and rules(good, [(1, "订单查询", "none")]) == {"evidence"}
    assert rules(good, t=targets.withColumn("generation_eligible", F.lit(False))) == {"eligible"}


def test_progress_known_answer(spark):
    make = spark.createDataFrame
    tasks = make([("t", "ALL", "GENERATING", 1), ("q", "ALL", "QUEUED", 1), ("a", "ALL", "AUDITING", 2)], "task_id string, mode string, status string, material_documents int")
    documents = make([("t", "d", True)], "task_id string, document_id string, complete boolean")
    units = make([("t", "u1"), ("t", "u2")], "task_id string, unit_id string")
    work = make([("t", "d", u, "COMPLETED", s, p) for u, s, p in (("u1", "FEATURE_LIST_SCAN", 1), ("u2", "REQUIREMENT_SCAN", 1), ("u2", "REQUIREMENT_SCAN", 2))], "task_id string, document_id string, unit_id string, status string, audit_stage string, audit_pass int")
    candidates = make([("t", f"c{k}") for k in range(6)], "task_id string, id string")
    kinds = ["FUNCTION_LIST_MISSING", "REQUIREMENT_MISSING", "SPLIT", "MERGE", "INSUFFICIENT_EVIDENCE"]
    conclusions = make([("t", k, k) for k in kinds], "task_id string, id string, conclusion_type string")
    links = make([("t", k, f"c{i}") for i, k in enumerate([*kinds, "SPLIT"])], "task_id string, conclusion_id string, candidate_id string")
    frozen = make([("t", k < 4) for k in range(5)], "task_id string, generation_eligible boolean")
    batches = make([("b", "t", "RUNNING")], "id string, task_id string, status string")
    cases = make([("b",)], "batch_id string")
    out = {r.task_id: r for r in P.progress(tasks, documents, units, work, candidates, links, conclusions, frozen, batches, cases).collect()}
    t = out["t"]
    assert (t.function_list_missing, t.requirement_missing, t.splits, t.merges, t.insufficient_evidence, t.conflicts) == (1, 1, 1, 1, 1, 0)
    assert (t.frozen_complete, t.frozen_features, t.eligible_features, t.ineligible_features, t.expected_cases, t.accepted_cases) == (True, 5, 4, 1, 8, 0)
    assert (t.processed_units, t.total_work, t.business_stage, t.coverage_status) == (2, 3, "测试用例生成", "进行中")
    assert out["q"].business_stage == "排队等待" and out["q"].frozen_features is None and out["a"].business_stage == "材料清单"
    finished = R.ready_to_finish(make([("b", "t", "ACCEPTED"), ("c", "t", "ACCEPTED")], "id string, task_id string, status string"), make([("b",), ("b",), ("c",)], "batch_id string"), make([("b", 1, "FAILED"), ("b", 2, "COMPLETED")], "batch_id string, attempt_number int, status string")).first()
    assert (finished.total, finished.accepted, finished.incomplete, finished.latest_failed, finished.ready) == (2, 2, 1, 0, False)


def test_transitions_and_queue(spark):
    pairs = [(a, b) for a in L.TASK_TRANSITIONS for b in L.TASK_TRANSITIONS]
    bad = {(r.source, r.target) for r in L.illegal_transitions(spark.createDataFrame([*pairs, (None, "QUEUED")], "source string, target string"), L.TASK_TRANSITIONS).collect()}
    assert bad == {(a, b) for a, b in pairs if b not in L.TASK_TRANSITIONS[a]} | {(None, "QUEUED")}
    tasks = spark.createDataFrame([(k, "QUEUED") for k in range(6)], "id int, status string")
    assert [r.id for r in L.claim(tasks, tasks.limit(0), 5, [F.col("id")]).collect()] == [0, 1, 2, 3, 4]
    assert L.claim(tasks, tasks.limit(5), 5, [F.col("id")]).count() == 0
    with pytest.raises(ValueError, match="1 to 100"):
        L.page(tasks, [F.col("id")], 0, 101)
    with pytest.raises(Exception, match="unique: 7"):
        L.require_none(L.check_unique(spark.createDataFrame([(7,), (7,)], "id int"), ["id"])).collect()


def unit(k, **changes):
    return {"unit_id": f"u{k}", "chunk_index": k, "ordinal": k, "content": "x", "start_at": 0, "end_at": 1} | changes


def test_paging(spark):
    schema = "document_id string, page int, knowledge_id string, total_units int, complete boolean, units array<struct<unit_id string, chunk_index int, ordinal int, content string, start_at bigint, end_at bigint>>"
    good = [("d", 1, "d", 3, False, [unit(1), unit(2)]), ("d", 2, "d", 3, True, [unit(3)])]

    def rules(*pages):
        return {r.rule for r in paging.unit_violations(spark.createDataFrame(list(pages), schema)).collect()}

    second = lambda *units, **k: ("d", 2, k.get("id", "d"), k.get("total", 3), k.get("end", True), list(units))
    assert rules(*good) == set()
    assert rules(good[0], second(unit(3), id="x")) == {"same id"} and "same total" in rules(good[0], second(unit(3), total=4))
    assert "unique units" in rules(good[0], second(unit(3, unit_id="u2"))) and rules(good[0], second(unit(3, ordinal=4))) == {"ordinals"}
    assert rules(good[0], second(unit(3, chunk_index=1))) == {"order"} and rules(good[0]) == {"count", "end"}
    pages = {None: {"data": [1], "has_more": True, "next_cursor": "a"}, "a": {"data": [2], "has_more": False}}
    assert list(paging.by_cursor(pages.__getitem__)) == [1, 2]
    for bad in ({"data": [], "has_more": True, "next_cursor": "b"}, {"data": [1], "has_more": True}, {"data": [1], "has_more": True, "next_cursor": "a"}, {"success": False}):
        with pytest.raises(paging.PageError):
            list(paging.by_cursor(lambda cursor, bad=bad: pages[None] if cursor is None else bad))
    assert list(paging.by_number(lambda n: {"data": [n], "total": 3})) == [1, 2, 3]
    with pytest.raises(paging.PageError):
        list(paging.by_number(lambda n: {"data": [], "total": 1}))
    calls = []

    def flaky(status):
        calls.append(status)
        raise paging.RemoteError(status)

    for status, n in ((503, 3), (404, 1)):
        calls.clear()
        with pytest.raises(paging.RemoteError):
            paging.with_retry(lambda status=status: flaky(status))
        assert len(calls) == n


def fetch_numbers(page, size):
    return {"data": [{"n": k} for k in range((page - 1) * size, min(page * size, 25))], "total": 25}


def test_numbered_pages_source(spark):
    spark.dataSource.register(paging.NumberedPages)
    df = spark.read.format("numbered_pages").schema("n int").options(fetch="tests.test_ledger:fetch_numbers", size="10").load()
    assert sorted(r.n for r in df.collect()) == list(range(25)) and df.rdd.getNumPartitions() == 3


def test_workbook(spark, tmp_path):
    a = spark.createDataFrame([(1, "=sum", "l1\nl2"), (2, None, "<&>")], "n int, a string, b string").orderBy("n")
    path = str(tmp_path / "x.xlsx")
    digest = write_workbook(path, [("审查", ["n", "a", "b"], a), ("empty", ["q"], a.select("a").limit(0))])
    assert read_workbook(path) == {"审查": [["n", "a", "b"], ["1", "'=sum", "l1\nl2"], ["2", "", "<&>"]], "empty": [["q"]]}
    with open(path, "rb") as f:
        assert hashlib.sha256(f.read()).hexdigest() == digest


def test_workbook_refuses_images_and_bound_evidence(spark, tmp_path):
    sheet = lambda text: [("s", ["a"], spark.createDataFrame([(text,)], "a string"))]
    for text in ("see ![x](y)", "x documentId = 3", "unitId=1"):
        with pytest.raises(ValueError):
            write_workbook(str(tmp_path / "bad.xlsx"), sheet(text))
    write_workbook(str(tmp_path / "good.xlsx"), sheet("mydocumentId=1"), {"s": [12.5]})
    with zipfile.ZipFile(tmp_path / "good.xlsx") as z:
        assert b'width="12.5"' in z.read("xl/worksheets/sheet1.xml")


EVENTS = [("s", 1, '{"response_type":"answer","content":"he"}'), ("s", 2, '{"response_type":"tool_call"}'), ("s", 3, '{"response_type":"answer","content":"llo"}'), ("s", 4, '{"response_type":"complete","done":true}'), ("s", 5, '{"response_type":"answer","content":"late"}'), ("e", 1, '{"response_type":"error","done":true,"message":"m"}'), ("u", 1, '{"response_type":"answer","content":"x"}')]


def test_answers(spark, tmp_path):
    events = answers.classify(spark.createDataFrame(EVENTS, "stream_id string, seq bigint, data string"))
    want = {"s": ("hello", "complete"), "e": (None, "error"), "u": (None, "unterminated")}
    assert {r.stream_id: (r.answer, r.status) for r in answers.fold(events).collect()} == want
    assert {r.status for r in answers.fold(events, 3).where("stream_id = 's'").collect()} == {"oversized"}
    events.select("stream_id", "seq", "kind", "content").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("stream_id string, seq bigint, kind string, content string").parquet(f"{tmp_path}/in")
    q = answers.fold_stream(stream).writeStream.format("memory").queryName("answers_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {r.stream_id: (r.answer, r.status) for r in spark.table("answers_out").collect()} == {k: v for k, v in want.items() if k != "u"}


def test_a_stream_that_ended_does_not_time_out(spark, tmp_path):
    """A stream that has ended, and one that has not, both fall silent: only the second one is unterminated."""
    schema = "stream_id string, seq bigint, kind string, content string"
    rows = [[("done", 1, "answer", "a"), ("done", 2, "complete", ""), ("open", 1, "answer", "b")], [("other", 1, "answer", "c")], [("other", 2, "complete", "")]]
    for k, r in enumerate(rows):
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{k}")
    import shutil
    import time

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = answers.fold_stream(stream, timeout_ms=1000).writeStream.format("memory").queryName("answers_timeout").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    found = lambda: sorted((r.stream_id, r.status) for r in spark.table("answers_timeout").collect())
    try:
        for k, until in ((0, ("done", "complete")), (1, ("open", "unterminated")), (2, ("other", "complete"))):
            for f in (tmp_path / str(k)).glob("*.parquet"):
                shutil.copy(f, tmp_path / "in" / f"{k}-{f.name}")
            deadline = time.time() + 20
            while time.time() < deadline and until not in found():
                time.sleep(1)
        got = found()
    finally:
        q.stop()
    assert [x for x in got if x[0] != "other"] == [("done", "complete"), ("open", "unterminated")]


def test_evidence_and_json_texts(spark):
    pair = lambda text: one(spark, X.has_coordinate_pair(F.col("t"), F.lit("d"), F.lit("u")), t=text)
    assert pair("x; documentId=d; unitId=u; y") and pair("documentId=e; documentId=d;unitId=u")
    assert not pair("documentId=d; note; unitId=u") and not pair("unitId=u; documentId=d") and not pair("documentId=d; unitId=v")
    cut = lambda text, n: one(spark, X.left_utf16(F.col("t"), n), t=text)
    assert (cut("abc", 5), cut("a\U0001f600b", 3), cut("a\U0001f600b", 2), cut("", 2)) == ("abc", "a\U0001f600", "a", "")
    first = lambda text: one(spark, X.first_text(F.col("t"), "$.a", "$.b", "$.in.c"), t=text)
    assert [first(x) for x in ('{"a": " ", "b": 3, "in": {"c": "z"}}', '{"a": "x"}', "[]", "not json")] == ["z", "x", None, None]
    many = lambda text: one(spark, X.one_or_many(F.col("t"), "keys", "key"), t=text)
    assert (many('{"keys": ["a", "b"]}'), many('{"key": "a"}'), many("{}")) == (["a", "b"], ["a"], None)
    notes = lambda *lines: one(spark, X.notes_only(F.array(*map(F.lit, lines))))
    assert notes("fine", " ", "more") and not notes("# head") and not notes("a |") and not notes("{}")
    assert [one(spark, X.positive_integer(F.col("t")), t=x) for x in ("12", "0", "-1", "1.5", "99999999999")] == [12, None, None, None, None]
    assert one(spark, X.without_machine_tokens(F.col("t")), t="documentId=a; unitId=b; read <br>candidateIds=c<br>") == "read"
    assert one(spark, X.sanitize(F.col("t")), t='{"token": "a\\"b"} api_key=xyz; sk-abcdefgh1') == '{"token": "<credential-redacted>"} api_key=<credential-redacted>; <credential-redacted>'
    assert one(spark, X.template("{a}-{b}", a=F.lit(1), b=F.lit(None))) == "1-"


def test_one_row_or_an_error(spark):
    from ledgerloom.plans.tasks import lookup

    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, v string")
    assert [tuple(r) for r in lookup(df, F.col("id") == 1, "row").collect()] == [(1, "a")]
    for k in (2, 3):
        with pytest.raises(Exception, match="rows found"):
            lookup(df, F.col("id") == k, "row").collect()


def test_numbers_in_ranges_are_those_of_a_window(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", i * 7 % 1000) for i in range(1000)] + [(None, i) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, n long").repartition(6)
    one, many = (sorted(map(str, x.collect())) for x in (L.numbered(df, ["g"], [F.col("n")]), L.numbered_in_ranges(df, ["g"], ["n"])))
    assert one == many
    assert L.numbered_in_ranges(df.limit(0), ["g"], ["n"]).count() == 0


def test_snapshot_is_swapped_only_when_it_is_whole(spark):
    from ledgerloom.plans.scope import Snapshot

    now, loads = [0.0], []

    def load():
        loads.append(len(loads))
        return spark.range(len(loads)) if len(loads) != 2 else spark.range(1).select(F.raise_error(F.lit("broken")).alias("id"))

    s = Snapshot(load, 10, lambda: now[0])
    assert s.get().count() == 1 and s.get().count() == 1 and len(loads) == 1
    now[0] = 11.0
    with pytest.raises(Exception, match="broken"):
        s.get()
    now[0] = 5.0
    assert s.get().count() == 1 and len(loads) == 2
    now[0] = 6.0
    assert s.get(refresh=True).count() == 3 and len(loads) == 3


def test_markdown_is_read_in_arrow_batches(spark, capsys):
    """Tables become columns without an object for each row; other columns pass unchanged, and null texts are refused."""
    rows = spark.sql("SELECT CAST(NULL AS STRING) AS markdown, CAST(1.5 AS DECIMAL(9, 2)) AS d, array(named_struct('a', 1)) AS s")
    read = M.read(rows, "generation")
    assert [(r.d, r.s[0].a, r.audit, r.cases, r.error) for r in read.collect()] == [(rows.first().d, 1, [], [], "no text")]
    read.explain()
    assert "MapInArrow" in capsys.readouterr().out
