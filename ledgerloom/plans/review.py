"""From scanned candidates to frozen targets, planned batches and accepted cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions.ids import UNIT, name_uuid
from ledgerloom.operators.ledger import check_unique, coverage, numbered

CONTENT = ["feature_text", "category", "evidence_text"]
GENERAL = "依据通用经验，待确认"


def second_pass(first: DataFrame, second: DataFrame, unit: tuple[str, ...] = ("task_id", "document_id", "unit_id")) -> DataFrame:
    """The second scan's rows with is_new: whether the unit's first scan has no row of the same content."""
    seen = first.select(*unit, *CONTENT, F.lit(True).alias("_seen")).distinct()
    return second.join(seen, [*unit, *CONTENT], "left").select(second["*"], F.col("_seen").isNull().alias("is_new"))


def target_paths(conclusions: DataFrame) -> DataFrame:
    """A row for each business path of each conclusion: path, its normal form and error where the contract breaks."""
    split = F.col("conclusion_type") == "SPLIT"
    parts = F.when(split, F.split("explanation", "<br>", -1)).otherwise(F.array("explanation"))
    rows = conclusions.withColumn("_n", F.size(parts)).withColumn("path", F.explode(F.transform(parts, lambda p: X.strip(p))))
    rows = rows.withColumn("normal", X.normal_path_in_rows(F.col("path")))
    error = (
        F.when(split & (F.col("_n") < 2), "a split needs two paths")
        .when(~split & F.contains("explanation", F.lit("<br>")), "only a split has several paths")
        .when(F.col("path") == "", "a blank path")
        .when(F.contains("path", F.lit("<")), "a path with markup")
    )
    return rows.withColumn("error", error).drop("_n")


def freeze(candidates: DataFrame, conclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, violations). ``conclusions`` has task_id, id, conclusion_type, explanation, candidate_ids.

    Targets are numbered in the order of their identity, which is a digest of the sorted candidates and the
    normal path. They hold only if there is no violation: conflicts, broken paths, paths given twice, or
    candidates without exactly one conclusion.
    """
    paths = target_paths(conclusions)
    identity = F.concat(F.lit("ff-"), F.sha2(F.concat_ws(UNIT, F.array_join(F.array_sort("candidate_ids"), UNIT), "normal"), 256))
    targets = paths.where("error IS NULL").select(
        "task_id",
        identity.alias("stable_feature_id"),
        F.col("path").alias("feature_name"),
        (F.col("conclusion_type") != "INSUFFICIENT_EVIDENCE").alias("generation_eligible"),
        F.struct(F.col("id").alias("conclusion_id"), "conclusion_type", F.array_sort("candidate_ids").alias("candidate_ids"), F.col("explanation").alias("decision_reason")).alias("source"),
    )
    targets = numbered(targets, ["task_id"], [F.col("stable_feature_id")], "stable_sequence")
    targets = targets.withColumn("id", name_uuid(F.concat_ws(UNIT, "task_id", "stable_feature_id")))
    row = lambda df, rule, key, detail: df.select(F.lit(rule).alias("rule"), F.col(key).alias("key"), detail.alias("detail"))
    covered = conclusions.select("task_id", F.explode("candidate_ids").alias("candidate"))
    whole = coverage(candidates.select(F.concat_ws("|", "task_id", "occurrence_id").alias("key")), covered.select(F.concat_ws("|", "task_id", "candidate").alias("key")), "key")
    violations = (
        row(conclusions.where("conclusion_type = 'CONFLICT'"), "conflict", "id", F.lit("unresolved"))
        .unionByName(row(paths.where("error IS NOT NULL"), "path", "id", F.col("error")))
        .unionByName(check_unique(paths.where("error IS NULL"), ["task_id", "normal"], "distinct path"))
        .unionByName(check_unique(candidates, ["task_id", "occurrence_id"], "distinct candidate"))
        .unionByName(row(whole, "one conclusion", "key", F.col("state")))
    )
    return targets, violations


def plan_batches(targets: DataFrame) -> DataFrame:
    """A batch for each eligible target, numbered from 1 in each task in the order of the targets."""
    return numbered(targets.where("generation_eligible"), ["task_id"], [F.col("stable_sequence")], "batch_sequence").select("task_id", "batch_sequence", F.col("stable_feature_id").alias("feature_id"), "feature_name")


def replayed_plans(stored: DataFrame, planned: DataFrame, parts: int | None = None) -> DataFrame:
    """(task_id, outcome) of plans (as ``plan_batches`` gives them): insert where a task has no batches, same where it has
    exactly these, and conflict where any batch is missing, more or different. Given ``parts``, all rows are dealt out by
    task into so many, once."""
    columns = ["task_id", "batch_sequence", "feature_id", "feature_name"]
    side = lambda df, n: df.select(*columns, F.lit(n == 0).cast("int").alias("_old"), F.lit(n == 1).cast("int").alias("_new"))
    both = side(stored, 0).unionByName(side(planned, 1))
    rows = (both if parts is None else both.repartition(parts, "task_id")).groupBy(*columns).agg(F.sum("_old").alias("_old"), F.sum("_new").alias("_new"))
    tasks = rows.groupBy("task_id").agg(F.sum("_old").alias("old"), F.sum("_new").alias("new"), F.bool_and(F.col("_old") == F.col("_new")).alias("equal"))
    return tasks.where("new > 0").select("task_id", F.when(F.col("old") == 0, "insert").when(F.col("equal"), "same").otherwise("conflict").alias("outcome"))


def refused_batches(targets: DataFrame, audit: DataFrame, cases: DataFrame) -> DataFrame:
    """(rule, key, detail) for each reason to refuse a batch; batches without a row are accepted.

    ``targets`` has batch_id, feature_name, generation_eligible and candidate_ids, a row a batch.
    """
    t = targets.select("batch_id", X.strip(F.col("feature_name")).alias("path"), X.leaf(X.strip(F.col("feature_name"))).alias("leaf"), "generation_eligible", "candidate_ids")
    out = lambda df, rule, detail: df.select(F.lit(rule).alias("rule"), F.col("batch_id").cast("string").alias("key"), detail.cast("string").alias("detail"))
    per = cases.groupBy("batch_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(X.strip(F.col("case_name")))).alias("names"))
    pair = F.array_sort(F.array(F.concat("leaf", F.lit("_正向")), F.concat("leaf", F.lit("_反向"))))
    counted = t.join(per, "batch_id", "left")
    rows = cases.join(t, "batch_id")
    need = X.strip(F.col("requirement_content"))
    ids = X.candidate_ids(need)
    foreign = F.when(need == GENERAL, False).otherwise(ids.isNull() | need.contains("依据通用经验") | (F.size(F.array_except(ids, "candidate_ids")) > 0))
    steps = X.numbered_from_one(F.col("execution_steps")) & X.numbered_from_one(F.col("expected_result")) & X.numbers_of(F.col("execution_steps")).eqNullSafe(X.numbers_of(F.col("expected_result")))
    audited = audit.join(t, "batch_id")
    evidence = X.candidate_ids(F.col("evidence"))
    return (
        out(t.where("NOT generation_eligible"), "eligible", F.lit("the target generates nothing"))
        .unionByName(out(counted.where("coalesce(n, 0) <> 2"), "two cases", F.coalesce("n", F.lit(0))))
        .unionByName(out(counted.where(F.col("names").isNotNull() & (F.col("names") != pair)), "names", F.array_join("names", ",")))
        .unionByName(out(rows.where(X.strip(F.col("feature_module")) != F.col("path")), "module", F.col("feature_module")))
        .unionByName(out(rows.where(~F.coalesce(steps, F.lit(False))), "numbering", F.col("case_name")))
        .unionByName(out(rows.where(F.coalesce(foreign, F.lit(True))), "requirement", F.col("requirement_content")))
        .unionByName(out(audited.where(~X.strip(F.col("subject")).isin(F.col("path"), F.col("leaf"))), "subject", F.col("subject")))
        .unionByName(out(audited.where(evidence.isNull() | (F.size(F.array_except(evidence, "candidate_ids")) > 0)), "evidence", F.col("evidence")))
    )


def ready_to_finish(batches: DataFrame, cases: DataFrame, attempts: DataFrame, per_batch: int = 2) -> DataFrame:
    """(task_id, total, accepted, incomplete, latest_failed, ready): whether a task's batches allow its end."""
    counted = batches.join(cases.groupBy(F.col("batch_id").alias("id")).agg(F.count("*").alias("n_cases")), "id", "left")
    last = Window.partitionBy("batch_id").orderBy(F.col("attempt_number").desc())
    failed = attempts.withColumn("_n", F.row_number().over(last)).where("_n = 1 AND status = 'FAILED'").select(F.col("batch_id").alias("id"), F.lit(True).alias("failed"))
    accepted = F.col("status") == "ACCEPTED"
    out = counted.join(failed, "id", "left").groupBy("task_id").agg(
        F.count("*").alias("total"), F.count_if(accepted).alias("accepted"), F.count_if(accepted & (F.coalesce("n_cases", F.lit(0)) != per_batch)).alias("incomplete"), F.count_if(F.col("failed")).alias("latest_failed")
    )
    return out.withColumn("ready", (F.col("total") == F.col("accepted")) & (F.col("incomplete") == 0))
