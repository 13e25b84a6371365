"""Scope, traversal, validators and strict JSON, by small known cases."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import reconcile as R
from ledgerloom.plans import scope as S
from ledgerloom.plans import validators as V
from ledgerloom.sources import structured as J

SCOPE = "struct<system_id:string,version_id:string,project_id:string,content_category:string,content_type_key:string,content_type_name:string>"
DOC = f"id string, knowledge_base_id string, file_hash string, parse_status string, enable_status string, knowledge_scope {SCOPE}"


def doc(i, key="function_list", label="功能清单", category=S.ADMISSION, enabled="enabled", h=None):
    return (i, "kb", h or f"h-{i}", "completed", enabled, ("sys", "v1", "p", category, key, label))


def chosen(spark, docs):
    return S.selections(
        spark.createDataFrame([("kb", "base", "document"), ("faq", "other", "faq")], "id string, name string, type string"),
        spark.createDataFrame([("kb", "system", "sys", None), ("faq", "team", "sys", "x")], "knowledge_base_id string, container_type string, system_id string, system_name string"),
        spark.createDataFrame([("v1", "sys", "1.0", "active"), ("v0", "sys", "0.9", "disabled")], "id string, system_id string, display_name string, status string"),
        spark.createDataFrame(docs, DOC),
    )


def test_catalog(spark):
    docs = [doc("d1"), doc("d2", "requirements_spec", " "), doc("d3", enabled="disabled"), doc("d4", category="example")]
    got = chosen(spark, docs)
    tree = S.catalog_tree(got).collect()
    assert len(tree) == 1 and len(tree[0].systems) == 1 and tree[0].systems[0].name == "base"
    (version,) = tree[0].systems[0].versions
    assert [(m.label, m.n_documents) for m in version.material_types] == [("requirements_spec", 1), ("功能清单", 1)]
    assert all(r.selection_id.startswith("scope-") and len(r.selection_id) == 30 for r in got.collect())
    task = got.withColumn("task_id", F.lit("t"))
    assert S.selection_violations(task).count() == 0
    assert {r.rule for r in S.selection_violations(task.where("type_key = 'function_list'")).collect()} == {"formal requirement"}
    same = chosen(spark, [doc("d1", h="x"), doc("d2", "work_order_plan", h="x")]).withColumn("task_id", F.lit("t"))
    assert [(r.rule, r.detail) for r in S.selection_violations(same).collect()] == [("distinct hashes", "x")]
    mixed = task.unionByName(task.withColumn("project_id", F.lit("q")).withColumn("hashes", F.array(F.struct(F.lit("d9").alias("document_id"), F.lit("h9").alias("file_hash")))))
    assert {"one coordinate", "hashes of documents"} <= {r.rule for r in S.selection_violations(mixed).collect()}


def test_roles_and_work(spark):
    rows = spark.createDataFrame([("requirements_spec", ["a", "b"]), (None, ["function_list"])], "k string, a array<string>")
    assert [r.r for r in rows.select(S.role(F.col("k"), F.col("a")).alias("r")).collect()] == ["REQUIREMENT", "FUNCTION_LIST"]
    for bad in ((None, ["function_list", "requirements_spec"]), ("other", ["function_list"])):
        with pytest.raises(Exception, match="no role"):
            spark.createDataFrame([bad], "k string, a array<string>").select(S.role(F.col("k"), F.col("a"))).collect()
    units = spark.createDataFrame([("t", "d", "u1", "FUNCTION_LIST"), ("t", "d", "u2", "REQUIREMENT")], "task_id string, document_id string, unit_id string, role string")
    work = S.open_work(units).collect()
    assert sorted((w.unit_id, w.audit_stage, w.audit_pass) for w in work) == [("u1", "FEATURE_LIST_SCAN", 1), ("u2", "REQUIREMENT_SCAN", 1), ("u2", "REQUIREMENT_SCAN", 2)]
    assert len({w.id for w in work}) == 3 and S.open_work(units).collect() == work


EVIDENCE = "task_id string, evidence_key string, material_key string, example_scope boolean, retired boolean, fully_traversed boolean"


def evidence(spark):
    return spark.createDataFrame([("t", "e1", "m", False, False, True), ("t", "e2", "other", False, False, True), ("t", "e3", "m", False, True, True)], EVIDENCE)


def rules(df):
    return {r.rule for r in df.collect()}


def test_material_review(spark):
    work = "work_id string, task_id string, material_key string, supplementary boolean"
    fact, finding = "work_id string, fact_key string, function string, evidence_keys array<string>", "work_id string, finding_key string, handling_level string, evidence_keys array<string>"

    def run(facts, findings=(), supplementary=False):
        return rules(V.material_review(spark.createDataFrame([("w", "t", "m", supplementary)], work), spark.createDataFrame(facts, fact), spark.createDataFrame(list(findings), finding), evidence(spark)))

    good = ("w", "f1", "login", ["e1"])
    assert run([good], [("w", "g1", "HIGH", [])]) == set()
    assert run([]) == {"0 to 200 rows, at least one"} and run([good, good]) == {"fact_key unique"}
    assert run([("w", f"f{k}", "x", ["e1"]) for k in range(201)]) == {"0 to 200 rows, at least one"}
    assert run([good], supplementary=True) == {"supplementary material"} and run([("w", "f1", " ", [])]) == {"function nonblank", "evidence"}
    assert run([("w", "f1", "x", ["e2"])]) == {"fact evidence"} == run([("w", "f1", "x", ["e3"])]) and run([("w", "f1", "x", ["e1", "e1"])]) == {"fact evidence distinct"}
    assert run([good], [("w", "g1", None, [])]) == {"handling level"}


def test_reconciliation(spark):
    row = "work_id string, reconciliation_key string, item_keys array<string>, fact_keys array<string>, classification string, confirmation_status string, evidence_keys array<string>"
    work = spark.createDataFrame([("w", "t")], "work_id string, task_id string")
    sources = spark.createDataFrame([("w", "FUNCTION_LIST_ITEM", "i1"), ("w", "REQUIREMENT_FACT", "f1")], "work_id string, family string, key string")
    allowed = spark.createDataFrame([("w", "e1"), ("w", "e3")], "work_id string, key string")

    def run(*rows_):
        return rules(V.reconciliation(work, sources, spark.createDataFrame(list(rows_), row), allowed, evidence(spark)))

    assert run(("w", "r1", ["i1"], ["f1"], "MATCHED", "OK", ["e1"])) == set()
    assert run(("w", "r1", ["i1"], [], "MATCHED", "OK", [])) == {"covered"} and run() == {"1 to 200 rows", "covered"}
    assert run(("w", "r1", ["f1"], ["f1"], "M", "O", [])) == {"item", "covered"}
    assert run(("w", "r1", ["i1", "i1"], ["f1"], None, "O", ["e2"])) == {"item distinct", "classified", "evidence"}
    assert run(("w", "r1", ["i1"], ["f1"], "M", "O", ["e3"]), ("w", "r1", [], [], "M", "O", [])) == {"evidence", "reconciliation_key unique", "a source"}


def test_testcases(spark):
    work = "work_id string, task_id string, function_key string, test_point_key string, basis string"
    case = "work_id string, case_key string, case_status string, fact_keys array<string>, evidence_keys array<string>, step_numbers array<int>"
    pair = lambda *k: spark.createDataFrame([("w", x) for x in k], "work_id string, key string")

    def run(*cases, basis="FORMAL_REQUIREMENT", echo="fn"):
        results = spark.createDataFrame([("w", echo, "tp")], "work_id string, function_key string, test_point_key string")
        return rules(V.testcases(spark.createDataFrame([("w", "t", "fn", "tp", basis)], work), results, spark.createDataFrame(list(cases), case), pair("f1"), pair("e1"), evidence(spark)))

    good = ("w", "c1", "FORMAL", ["f1"], ["e1"], [1, 2])
    assert run(good) == set() and run(good, echo="x") == {"echo"} and run(good, good) == {"case_key unique"}
    assert run() == {"1 to 50 cases", "a formal case"} and run(good, basis="GENERAL_EXPERIENCE") == {"general experience"}
    assert run(("w", "c1", "PENDING_CONFIRMATION", ["f1"], [], [1])) == {"a formal case"}
    assert run(("w", "c1", "FORMAL", ["x"], ["e2"], [2, 1])) == {"fact", "evidence", "steps"} and run(("w", "c1", None, [], [], [])) == {"status", "steps", "a formal case"}


def test_registry(spark):
    keys = spark.createDataFrame([("t", "A", "k"), ("t", "B", "k"), ("u", "A", "k")], "task_id string, family string, key string")
    assert [(r.rule, r.key, r.detail) for r in V.registry_violations(keys, evidence(spark)).collect()] == [("key unique", "t", "k")]


def test_strict_json(spark):
    good = json.dumps({"success": True, "data": {"schema_version": "1", "skill_name": "s", "repair_attempted": False, "result": {"a": 1, "b": [2]}}})
    bad = [None, "", "[]", good.replace("true", "false"), good.replace('"a": 1', '"a": 1, "a": 2'), good.replace('"b"', '"c"'), good.replace('"skill_name"', '"name"'), "x" * (5 << 20)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([good, *bad])], "k int, answer string")
    out = {r.k: r for r in J.checked(rows, ["a", "b"]).collect()}
    assert out[0].error is None and json.loads(out[0].result) == {"a": 1, "b": [2]}
    assert all(out[k].error and out[k].result is None for k in range(1, 9))
    text = "---\nid: a:b\nname:  x \n---\n# t\n## one\nl1\nl2\n\n## two\nl3"
    r = spark.createDataFrame([(text,)], "t string").select(J.front_matter(F.col("t")).alias("m"), J.section(F.col("t"), "one").alias("o"), J.section(F.col("t"), "two").alias("w"), J.section(F.col("t"), "three").alias("n")).first()
    assert r.m == {"id": "a:b", "name": "x"} and r.o.split("\n")[:2] == ["l1", "l2"] and r.w == "l3" and r.n is None


def test_normal_paths_by_dictionary(spark):
    """Equal to the expression on every row; Python is given distinct values that are not ASCII only."""
    from ledgerloom.functions import text as X

    rows = [(k, v, "old") for k, v in enumerate(["Ａ／Ｂ  c", "Ａ／Ｂ  c", " plain  Text ", None, "", "ﬁne　 é", "ﬁne　 é", "é"])]
    df = spark.createDataFrame(rows, "k int, path string, normal string")
    got = X.with_normal_path(df, "path", "normal")
    want = df.withColumn("normal", X.normal_path(df["path"]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.columns == ["k", "path", "normal"]
    assert {r.normal for r in got.where("k IN (0, 1)").collect()} == {"a/b c"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("nfkc(") == 1 and "Aggregate" in plan[plan.index("nfkc(") :]


def test_concluded_says_what_pages_groups_and_joins_say(spark):
    """One dealing-out by task gives what the joins of ``settled`` and ``projected`` give, and plans two shuffles of rows at most."""
    rows = [(f"T{k % 3}" if k % 50 else None, f"C{k}", k * 7 % 97, ["A / b", " a /  B", "Ｃ", " ", None][k % 5], f"D{k % 2}", f"U{k}", f"documentId=D{k % 2}; line {k}") for k in range(150)]
    candidates = spark.createDataFrame(rows, "task_id string, occurrence_id string, position int, feature_text string, document_id string, unit_id string, evidence_text string")
    said = [(r[0], r[1], ["SPLIT", "MATCHED", "MERGE"][k % 3], ["a / b", "c", "other"][k % 4 % 3], f"groupAnchorId={r[1]}") for k, r in enumerate(rows) if k % 11]
    judged = spark.createDataFrame(said, "task_id string, occurrence_id string, type string, explanation string, evidence string")
    paged = R.pages(candidates)
    settled = R.settled(paged, judged)
    got = R.concluded(candidates, judged)
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert as_rows(R.bound(got)) == as_rows(R.projected(paged, settled))
    columns = ["task_id", "page", "path", "source_id", "type", "explanation", "evidence", "reused"]
    assert as_rows(got.where("leads").select(columns)) == as_rows(settled.select(columns))
    plan = R.bound(got)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
