"""Business progress of tasks: all measures by grouped aggregates, one row a task, and the derived stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stage, coverage and reason texts.
STAGES = {"QUEUED": "排队等待", "GENERATING": "测试用例生成", "VALIDATING": "结果校验", "COMPLETED": "已完成", "PARTIAL": "部分完成", "FAILED": "已失败", "CANCELLED": "已取消"}
AUDIT_STAGES = ["材料清单", "功能清单扫描", "需求扫描（第一遍）", "需求扫描（第二遍）", "双向核对", "功能冻结", "审查收敛"]
COVERAGE = {"whole": "完整", "cases": "审查完整但用例不完整", "failed": "材料或审查失败", "cancelled": "已取消", "open": "进行中"}
REASONS = {
    "whole": "材料审查、功能冻结和测试用例均已完成",
    "cases": "审查已完成，但部分功能未接收测试用例",
    "failed": "材料清单或审查未完成，不能视为完整交付",
    "cancelled": "任务已取消，未形成完整交付",
    "open": "正在处理材料、审查或测试用例",
}
CONCLUSIONS = {"FUNCTION_LIST_MISSING": "function_list_missing", "REQUIREMENT_MISSING": "requirement_missing", "CONFLICT": "conflicts", "SPLIT": "splits", "MERGE": "merges", "INSUFFICIENT_EVIDENCE": "insufficient_evidence"}


def progress(
    tasks: DataFrame, documents: DataFrame, units: DataFrame, work: DataFrame, candidates: DataFrame, links: DataFrame, conclusions: DataFrame, frozen: DataFrame, batches: DataFrame, cases: DataFrame
) -> DataFrame:
    """A row for each of ``tasks`` (task_id, mode, status, material_documents) with its measures.

    Each table is aggregated by task before it is joined, so that what moves is a few numbers a task; the
    result is that of one statement of cross-joined one-row aggregates, for all tasks at once. Measures
    that only hold once the targets are frozen are null until then.
    """
    by = lambda df, *aggs: df.groupBy("task_id").agg(*aggs)
    n = lambda c, name: F.count_if(c).alias(name)
    open_ = F.col("status") != "COMPLETED"
    per_unit = work.groupBy("task_id", "document_id", "unit_id").agg(F.bool_and(F.col("status") == "COMPLETED").alias("done"))
    joined = links.join(conclusions.select("task_id", F.col("id").alias("conclusion_id"), "conclusion_type"), ["task_id", "conclusion_id"])
    accepted = cases.join(batches.where("status = 'ACCEPTED'").select(F.col("id").alias("batch_id"), "task_id"), "batch_id")
    parts = [
        by(documents.where("complete"), F.count("*").alias("complete_documents")),
        by(units, F.count("*").alias("total_units")),
        by(per_unit, n(F.col("done"), "processed_units")),
        by(
            work,
            F.count("*").alias("total_work"),
            n(~open_, "completed_work"),
            n(F.col("status") == "FAILED", "failed_work"),
            n(open_ & (F.col("audit_stage") == "FEATURE_LIST_SCAN"), "pending_function_list"),
            n(open_ & (F.col("audit_stage") == "REQUIREMENT_SCAN") & (F.col("audit_pass") == 1), "pending_requirement_first_pass"),
            n(open_ & (F.col("audit_stage") == "REQUIREMENT_SCAN") & (F.col("audit_pass") == 2), "pending_requirement_second_pass"),
        ),
        by(candidates, F.count("*").alias("candidates")),
        by(joined, F.count("*").alias("covered_candidates"), *(F.countDistinct(F.when(F.col("conclusion_type") == k, F.col("conclusion_id"))).alias(v) for k, v in CONCLUSIONS.items())),
        by(frozen, F.count("*").alias("_frozen"), n(F.col("generation_eligible"), "_eligible"), n(~F.col("generation_eligible"), "_ineligible")),
        by(accepted, F.count("*").alias("accepted_cases")),
    ]
    out = tasks
    for p in parts:
        out = out.join(p, "task_id", "left")
    return derived(out.fillna(0, [c for c in out.columns if c not in tasks.columns]))


def derived(out: DataFrame) -> DataFrame:
    """Tasks and their counts with what follows from them."""
    c = F.col
    complete = (
        (c("mode") == "ALL")
        & (c("material_documents") > 0)
        & (c("complete_documents") == c("material_documents"))
        & (c("total_units") > 0)
        & (c("total_work") > 0)
        & (c("total_work") == c("completed_work"))
        & (c("failed_work") == 0)
        & (c("candidates") > 0)
        & (c("candidates") == c("covered_candidates"))
        & (c("conflicts") == 0)
        & (c("_frozen") > 0)
    )
    out = out.withColumn("frozen_complete", complete)
    once = lambda x: F.when(c("frozen_complete"), x)
    kind = state(c("status"), c("frozen_complete"))
    return out.withColumns(
        {
            "frozen_features": once(c("_frozen")),
            "eligible_features": once(c("_eligible")),
            "ineligible_features": once(c("_ineligible")),
            "expected_cases": once(c("_eligible") * 2),
            "business_stage": stage(),
            "coverage_status": label(kind, COVERAGE),
            "reason": label(kind, REASONS),
        }
    ).drop("_frozen", "_eligible", "_ineligible")


def state(status: Column, frozen: Column) -> Column:
    """Which of the coverage and reason texts holds."""
    return (
        F.when(status == "COMPLETED", "whole")
        .when((status == "PARTIAL") | (status == "FAILED") & frozen, "cases")
        .when(status == "FAILED", "failed")
        .when(status == "CANCELLED", "cancelled")
        .otherwise("open")
    )


def label(key: Column, labels: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in labels.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def stage() -> Column:
    c, a = F.col, AUDIT_STAGES
    audit = (
        F.when(c("complete_documents") < c("material_documents"), a[0])
        .when(c("pending_function_list") > 0, a[1])
        .when(c("pending_requirement_first_pass") > 0, a[2])
        .when(c("pending_requirement_second_pass") > 0, a[3])
        .when(c("candidates") != c("covered_candidates"), a[4])
        .when(c("frozen_complete"), a[5])
        .otherwise(a[6])
    )
    return F.when(c("status") == "AUDITING", audit).otherwise(label(c("status"), STAGES))
