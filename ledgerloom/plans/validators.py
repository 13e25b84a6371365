"""Validators of structured results. Each returns (rule, key, detail) rows; no rows mean that a result is valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X


def _rows(df: DataFrame, rule: str, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col("work_id").cast("string").alias("key"), detail.cast("string").alias("detail"))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _counts(work: DataFrame, **tables: DataFrame) -> DataFrame:
    out = work.select("work_id")
    for name, df in tables.items():
        out = out.join(df.groupBy("work_id").agg(F.count("*").alias(name)), "work_id", "left")
    return out.fillna(0, list(tables))


def _repeated(df: DataFrame, column: str) -> DataFrame:
    blank = _rows(df.where(X.is_blank(F.col(column))), f"{column} nonblank", F.lit("blank"))
    return blank.unionByName(_rows(df.groupBy("work_id", column).agg(F.count("*").alias("n")).where("n > 1"), f"{column} unique", F.col(column)))


def _keys(df: DataFrame, column: str, allowed: DataFrame, rule: str) -> DataFrame:
    """Keys in an array column that are given twice in it, or are not among ``allowed`` (work_id, key)."""
    twice = _rows(df.where(F.size(F.array_distinct(column)) < F.size(column)), f"{rule} distinct", F.array_join(column, ","))
    foreign = df.select("work_id", F.explode(column).alias("key")).join(allowed.select("work_id", "key"), ["work_id", "key"], "left_anti")
    return twice.unionByName(_rows(foreign, rule, F.col("key")))


def usable_evidence(evidence: DataFrame) -> DataFrame:
    """(task_id, key, material_key) of evidence that results may cite."""
    usable = evidence.where(~F.col("example_scope") & ~F.col("retired") & F.col("fully_traversed"))
    return usable.select("task_id", F.col("evidence_key").alias("key"), "material_key")


def _citable(work: DataFrame, evidence: DataFrame, by_material: bool = False) -> DataFrame:
    on = ["task_id", "material_key"] if by_material else ["task_id"]
    return work.select("work_id", *on).join(usable_evidence(evidence), on).select("work_id", "key").distinct()


def registry_violations(keys: DataFrame, evidence: DataFrame) -> DataFrame:
    """A key belongs to one family of a task and is registered once (task_id, family, key); evidence likewise."""
    as_work = lambda df: df.withColumnRenamed("task_id", "work_id")
    return _repeated(as_work(keys), "key").unionByName(_repeated(as_work(evidence), "evidence_key"))


def material_review(work: DataFrame, facts: DataFrame, findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """``work`` has work_id, task_id, material_key and supplementary; facts and findings work_id, a key and evidence_keys."""
    n = _counts(work, facts=facts, findings=findings)
    citable = _citable(work, evidence, True)
    backed = facts.join(work.where("supplementary").select("work_id"), "work_id", "left_semi")
    return _all(
        _rows(n.where("facts > 200 OR findings > 200 OR facts + findings < 1"), "0 to 200 rows, at least one", F.concat_ws("+", "facts", "findings")),
        _repeated(facts, "fact_key"),
        _repeated(findings, "finding_key"),
        _rows(facts.where(X.is_blank(F.col("function"))), "function nonblank", F.col("fact_key")),
        _rows(backed, "supplementary material", F.col("fact_key")),
        _rows(facts.where(F.size("evidence_keys") == 0), "evidence", F.col("fact_key")),
        _rows(findings.where("handling_level IS NULL"), "handling level", F.col("finding_key")),
        _keys(facts, "evidence_keys", citable, "fact evidence"),
        _keys(findings, "evidence_keys", citable, "finding evidence"),
    )


def reconciliation(work: DataFrame, sources: DataFrame, rows: DataFrame, allowed: DataFrame, evidence: DataFrame) -> DataFrame:
    """``sources`` (work_id, family, key) must each be covered by ``rows``; ``allowed`` (work_id, key) is citable evidence."""
    n = _counts(work, rows=rows)
    of = lambda family: sources.where(F.col("family") == family)
    used = rows.select("work_id", F.explode(F.concat("item_keys", "fact_keys")).alias("key")).distinct()
    citable = _citable(work, evidence).join(allowed, ["work_id", "key"], "left_semi")
    return _all(
        _rows(n.where("rows NOT BETWEEN 1 AND 200"), "1 to 200 rows", F.col("rows")),
        _repeated(rows, "reconciliation_key"),
        _rows(rows.where(F.size("item_keys") + F.size("fact_keys") == 0), "a source", F.col("reconciliation_key")),
        _rows(rows.where("classification IS NULL OR confirmation_status IS NULL"), "classified", F.col("reconciliation_key")),
        _keys(rows, "item_keys", of("FUNCTION_LIST_ITEM"), "item"),
        _keys(rows, "fact_keys", of("REQUIREMENT_FACT"), "fact"),
        _keys(rows, "evidence_keys", citable, "evidence"),
        _rows(sources.join(used, ["work_id", "key"], "left_anti"), "covered", F.col("key")),
    )


def testcases(work: DataFrame, results: DataFrame, cases: DataFrame, facts: DataFrame, allowed: DataFrame, evidence: DataFrame) -> DataFrame:
    """``work`` has work_id, task_id, function_key, test_point_key and basis; ``cases`` an array step_numbers."""
    n = _counts(work, cases=cases)
    echo = work.join(results.select("work_id", F.col("function_key").alias("f"), F.col("test_point_key").alias("p")), "work_id", "left")
    based = cases.join(work.select("work_id", "basis"), "work_id")
    formal = cases.where("case_status = 'FORMAL'").select("work_id")
    citable = _citable(work, evidence).join(allowed, ["work_id", "key"], "left_semi")
    steps = (F.size("step_numbers") > 50) | (F.size("step_numbers") < 1) | (F.col("step_numbers") != F.sequence(F.lit(1), F.greatest(F.size("step_numbers"), F.lit(1))))
    return _all(
        _rows(echo.where("NOT (f <=> function_key AND p <=> test_point_key)"), "echo", F.concat_ws(",", "f", "p")),
        _rows(n.where("cases NOT BETWEEN 1 AND 50"), "1 to 50 cases", F.col("cases")),
        _repeated(cases, "case_key"),
        _rows(cases.where("case_status IS NULL"), "status", F.col("case_key")),
        _rows(based.where("basis = 'GENERAL_EXPERIENCE' AND case_status <> 'PENDING_CONFIRMATION'"), "general experience", F.col("case_key")),
        _rows(work.where("basis = 'FORMAL_REQUIREMENT'").join(formal, "work_id", "left_anti"), "a formal case", F.lit("missing")),
        _rows(cases.where(F.coalesce(steps, F.lit(True))), "steps", F.col("case_key")),
        _keys(cases, "fact_keys", facts, "fact"),
        _keys(cases, "evidence_keys", citable, "evidence"),
    )
