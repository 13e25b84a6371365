"""Tasks, their batches and attempts: details, pages, gates, retries, acceptance, recovery and replacement.

Changes of state come back as the changed rows; what a database would reject comes back as an outcome column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators.ledger import page as page_of

TERMINAL = ["COMPLETED", "PARTIAL", "FAILED", "CANCELLED"]
ENDED_BATCH = ["ACCEPTED", "FAILED", "CANCELLED"]
MAX_ATTEMPTS = 3


def lookup(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """The one row that meets the condition; fails, when run, if there is none or another. At most two rows are read."""
    found = df.where(condition).limit(2).agg(F.count("*").alias("n"), F.first(F.struct(*df.columns)).alias("r"))
    one = F.when(F.col("n") == 1, F.col("r")).otherwise(F.raise_error(F.concat(F.lit(f"{what}: rows found: "), F.col("n").cast("string"))).cast(df.schema))
    return found.select(one.alias("r")).select("r.*")


def if_set(column: Column, value: object) -> Column:
    """A condition that holds for all rows if the value is None."""
    return F.lit(True) if value is None else column == F.lit(value)


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """(batch_id, attempt_number, status, failure_reason, retryable) of each batch's last attempt, by partial aggregates."""
    last = F.max_by(F.struct("attempt_number", F.col("id").alias("attempt_id"), "status", "failure_reason", "retryable"), F.struct("attempt_number", "id"))
    return attempts.groupBy("batch_id").agg(last.alias("a")).select("batch_id", "a.*")


def batch_counts(batches: DataFrame) -> DataFrame:
    s = F.col("status")
    return batches.groupBy("task_id").agg(F.count("*").alias("total"), F.count_if(s.isin(ENDED_BATCH)).alias("completed"), F.count_if(s == "ACCEPTED").alias("accepted"), F.count_if(s == "FAILED").alias("failed"))


def failed_batches(batches: DataFrame, attempts: DataFrame) -> DataFrame:
    """Failed batches with their last attempt."""
    failed = batches.where("status = 'FAILED'").select("task_id", F.col("id").alias("batch_id"), "batch_sequence")
    return failed.join(latest_attempts(attempts), "batch_id")


def failure_summaries(batches: DataFrame, attempts: DataFrame) -> DataFrame:
    """(task_id, failure_summary): the reason of the first failed batch whose last attempt has one."""
    rows = failed_batches(batches, attempts).where("failure_reason IS NOT NULL")
    return rows.groupBy("task_id").agg(F.min_by("failure_reason", F.struct("batch_sequence", "attempt_id")).alias("failure_summary"))


def batch_details(batches: DataFrame, attempts: DataFrame) -> DataFrame:
    """(task_id, batch_id, batch_sequence, feature_id, status, failure_summary), the reason only of failed batches."""
    last = latest_attempts(attempts).select("batch_id", "failure_reason")
    rows = batches.select("task_id", F.col("id").alias("batch_id"), "batch_sequence", "feature_id", "status").join(last, "batch_id", "left")
    return rows.select("task_id", "batch_id", "batch_sequence", "feature_id", "status", F.when(F.col("status") == "FAILED", F.col("failure_reason")).alias("failure_summary"))


def task_details(tasks: DataFrame, batches: DataFrame, attempts: DataFrame, cases: DataFrame) -> DataFrame:
    """A row for each task: counts, failure, whether its artifact is ready, its batches in order, and the number of
    accepted rows. ``result_failure`` of a task stands in where no batch tells a reason."""
    details = batch_details(batches, attempts)
    nested = details.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("batch_sequence", "batch_id", "feature_id", "status", "failure_summary"))).alias("batches"))
    rows = cases.join(batches.where("status = 'ACCEPTED'").select(F.col("id").alias("batch_id"), "task_id"), "batch_id").groupBy("task_id").agg(F.count("*").alias("accepted_rows"))
    out = reduce(lambda a, b: a.join(b, "task_id", "left"), (batch_counts(batches), failure_summaries(batches, attempts), nested, rows), tasks)
    out = out.fillna(0, ["total", "completed", "accepted", "failed", "accepted_rows"])
    return out.withColumns({"failure_summary": F.coalesce("failure_summary", "result_failure"), "artifact_ready": F.col("artifact_id").isNotNull()})


def task_page(tasks: DataFrame, batches: DataFrame, attempts: DataFrame, page: int, size: int, query: str = "", status: str | None = None) -> DataFrame:
    """A page of the tasks whose id contains the query, newest first, with the number of all that do (total_items) and of
    pages. Batches are counted for the page's tasks alone."""
    found = tasks.where(X.contains_ignoring_case(F.col("task_id"), query) & if_set(F.col("status"), status))
    rows = page_of(found, [F.desc("created"), F.desc("task_id")], page, size)
    own = batches.join(rows.select("task_id"), "task_id", "left_semi")
    tried = attempts.join(own.select(F.col("id").alias("batch_id")), "batch_id", "left_semi")
    out = rows.join(batch_counts(own).select("task_id", "total", "completed"), "task_id", "left").join(failure_summaries(own, tried), "task_id", "left")
    out = out.crossJoin(F.broadcast(found.agg(F.count("*").alias("total_items"))))  # one row
    return out.select(
        "task_id", "mode", "status", "created", F.coalesce("total", F.lit(0)).alias("total_batches"), F.coalesce("completed", F.lit(0)).alias("completed_batches"),
        F.coalesce("failure_summary", "result_failure").alias("failure_summary"), F.col("artifact_id").isNotNull().alias("artifact_ready"), "total_items", page_count(F.col("total_items"), size).alias("pages"),
    )


def page_count(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("long")


def audit_gate(tasks: DataFrame, documents: DataFrame, work: DataFrame, candidates: DataFrame, conclusions: DataFrame, links: DataFrame, frozen: DataFrame) -> DataFrame:
    """(task_id, complete, reason): whether inventory, audit, conclusions and frozen targets of a task are whole, and if
    not, the first check that fails. ``frozen`` has task_id, stable_feature_id, stable_sequence, generation_eligible,
    conclusion_id, conclusion_type, decision_reason and candidate_ids (sorted)."""
    n = lambda c, name: F.count_if(c).alias(name)
    by = lambda df, *aggs: df.groupBy("task_id").agg(*aggs)
    # each comparison deals its rows out once and by what it compares, narrow as they are; a task's rows meet as counts
    of = links.groupBy("task_id", "conclusion_id").agg(F.array_sort(F.collect_list("candidate_id")).alias("own"))
    heads = conclusions.groupBy("task_id", F.col("id").alias("conclusion_id")).agg(F.count("*").alias("rows"), n(F.col("conclusion_type") == "CONFLICT", "conflicted"), F.min(F.struct(F.col("conclusion_type").alias("own_type"), F.col("explanation").alias("own_reason"))).alias("h"))
    known = heads.select("task_id", "conclusion_id", "rows", "conflicted", "h.*").join(of, ["task_id", "conclusion_id"], "left")
    shown = ["conclusion_type", "decision_reason", "candidate_ids", "generation_eligible"]
    pairs = frozen.select("task_id", "conclusion_id", *shown).join(known.drop("rows", "conflicted"), ["task_id", "conclusion_id"], "left")
    true_copy = (F.col("own_type") == F.col("conclusion_type")) & (F.col("own_type") != "CONFLICT") & (F.col("own_reason") == F.col("decision_reason")) & (F.col("own") == F.col("candidate_ids"))
    true_copy &= F.col("generation_eligible") == (F.col("own_type") != "INSUFFICIENT_EVIDENCE")
    copies = pairs.groupBy("task_id", "conclusion_id").agg(n(~F.coalesce(true_copy, F.lit(False)), "false"))
    asked = candidates.select("task_id", F.col("occurrence_id").alias("candidate_id"), F.lit(1).alias("c"), F.lit(0).alias("f"))
    told = frozen.select("task_id", F.explode("candidate_ids").alias("candidate_id"), F.lit(0).alias("c"), F.lit(1).alias("f"))
    met = asked.unionByName(told).groupBy("task_id", "candidate_id").agg(F.sum("c").alias("c"), F.max("f").alias("f"))
    identities = frozen.groupBy("task_id", "stable_feature_id").agg(F.count("*").alias("n"))
    sequences = frozen.groupBy("task_id", "stable_sequence").agg(F.count("*").alias("n"))
    parts = [
        by(documents, n(F.col("complete"), "complete_documents")),
        by(work, F.count("*").alias("total_work"), n(F.col("status") == "COMPLETED", "completed_work"), n(F.col("status") == "FAILED", "failed_work")),
        by(met, F.sum("c").alias("candidates"), n(F.expr("candidate_id IS NULL OR c = 0 OR f = 0"), "uncovered")),
        by(known, F.sum("rows").alias("n_conclusions"), F.count("conclusion_id").alias("n_ids"), F.sum("conflicted").alias("conflicts"), F.sum(F.coalesce(F.size("own"), F.lit(0))).alias("covered_candidates")),
        by(copies, F.sum("false").alias("false_copies"), F.count("conclusion_id").alias("frozen_conclusions")),
        by(identities, F.sum("n").alias("targets"), F.count("stable_feature_id").alias("target_ids")),
        by(sequences, F.count("stable_sequence").alias("sequences"), F.min("stable_sequence").alias("lo"), F.max("stable_sequence").alias("hi")),
    ]
    out = reduce(lambda a, b: a.join(b, "task_id", "left"), parts, tasks.select("task_id", "material_documents"))
    out = out.fillna(0, [c for c in out.columns if c not in ("task_id", "material_documents")])
    c = F.col
    reason = (
        F.when((c("material_documents") == 0) | (c("complete_documents") != c("material_documents")), "inventory")
        .when((c("total_work") == 0) | (c("total_work") != c("completed_work")) | (c("failed_work") > 0), "audit work")
        .when((c("candidates") == 0) | (c("candidates") != c("covered_candidates")), "candidate coverage")
        .when(c("targets") == 0, "no targets")
        .when((c("n_conclusions") == 0) | (c("n_conclusions") != c("n_ids")), "conclusions")
        .when((c("target_ids") != c("targets")) | (c("sequences") != c("targets")) | (c("lo") < 1) | (c("hi") > c("targets")), "target numbering")
        .when(c("false_copies") > 0, "targets against conclusions")
        .when(c("frozen_conclusions") != c("n_conclusions"), "conclusions without a target")
        .when(c("uncovered") > 0, "targets against candidates")
        .when(c("conflicts") > 0, "conflicts")
    )
    return out.select("task_id", reason.isNull().alias("complete"), reason.alias("reason"))


def finalization(tasks: DataFrame, batches: DataFrame, attempts: DataFrame, cases: DataFrame, targets: DataFrame, gate: DataFrame) -> DataFrame:
    """(task_id, terminal, exportable): the status in which each task ends. ``targets`` has task_id, stable_feature_id
    and generation_eligible, ``gate`` is that of ``audit_gate``, which only tasks of mode ALL must pass."""
    accepted = batches.where("status = 'ACCEPTED'").select("task_id", F.col("id").alias("batch_id"), "feature_id")
    per = accepted.join(cases.groupBy("batch_id").agg(F.count("*").alias("k")), "batch_id", "left").fillna(0, ["k"])
    frozen = per.join(targets.where("generation_eligible").select("task_id", F.col("stable_feature_id").alias("feature_id"), F.lit(1).alias("one")), ["task_id", "feature_id"], "left")
    lost = failed_batches(batches, attempts).where(f"NOT retryable OR attempt_number >= {MAX_ATTEMPTS}")
    parts = [
        batch_counts(batches),
        targets.groupBy("task_id").agg(F.count_if("generation_eligible").alias("eligible"), F.count_if(~F.col("generation_eligible")).alias("ineligible")),
        per.groupBy("task_id").agg(F.count_if(F.col("k") != 2).alias("not_two"), F.sum("k").alias("rows")),
        frozen.groupBy("task_id").agg(F.sum("one").alias("accepted_frozen")),
        lost.groupBy("task_id").agg(F.count("*").alias("lost")),
        gate.select("task_id", "complete"),
    ]
    out = reduce(lambda a, b: a.join(b, "task_id", "left"), parts, tasks.select("task_id", "mode"))
    numbers = [c for c, kind in out.dtypes if kind == "bigint"]
    out = out.fillna(0, numbers).fillna(False, ["complete"])
    c = F.col
    feature = F.when(c("accepted") == 0, "FAILED").when(c("failed") > 0, "PARTIAL").otherwise("COMPLETED")
    exact = (c("not_two") == 0) & (c("rows") == 2 * c("accepted"))
    whole = (c("total") == c("eligible")) & (c("completed") == c("eligible"))
    every = whole & (c("accepted") == c("eligible")) & (c("accepted_frozen") == c("eligible"))
    ended = whole & (c("accepted_frozen") == c("accepted")) & (c("accepted") + c("lost") == c("eligible"))
    part = ((c("ineligible") > 0) | (c("lost") > 0)) & ended & (c("accepted") > 0) & exact
    all_ = F.when(~c("complete"), "FAILED").when((c("ineligible") == 0) & every & exact, "COMPLETED").when(part, "PARTIAL").otherwise("FAILED")
    terminal = F.when(c("mode") == "ALL", all_).otherwise(feature)
    return out.select("task_id", terminal.alias("terminal"), (terminal != "FAILED").alias("exportable"))


def retries(batches: DataFrame, attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(task_id, batch_id, batch_sequence, next_attempt) of failed batches whose last attempt may be tried again."""
    again = failed_batches(batches, attempts).where(F.col("retryable") & (F.col("attempt_number") < max_attempts))
    return again.select("task_id", "batch_id", "batch_sequence", (F.col("attempt_number") + 1).alias("next_attempt"))


def requeued(tasks: DataFrame, batches: DataFrame, attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(task_id, status, new_status, retried, clears_artifact): what retrying does to each task. A failed task of mode ALL
    that never had a batch starts again as a whole."""
    n = retries(batches, attempts, max_attempts).groupBy("task_id").agg(F.count("*").alias("retried"))
    out = tasks.join(n, "task_id", "left").join(batches.select("task_id").distinct().withColumn("has_batches", F.lit(True)), "task_id", "left").fillna(0, ["retried"])
    some = (F.col("retried") > 0) & F.col("status").isin("PARTIAL", "FAILED")
    whole = (F.col("retried") == 0) & (F.col("status") == "FAILED") & (F.col("mode") == "ALL") & F.col("has_batches").isNull()
    return out.select("task_id", "status", F.when(some | whole, "QUEUED").otherwise(F.col("status")).alias("new_status"), (F.col("retried") + whole.cast("int")).alias("retried"), some.alias("clears_artifact"))


def acceptance(batches: DataFrame, attempts: DataFrame, results: DataFrame) -> DataFrame:
    """``results`` (batch_id, attempt_id) with an outcome: accepted, replay (accepted before), or refused (the batch or the
    attempt is not running, or the attempt is another batch's). Of several results of a batch in one go, that of the
    smallest attempt that can be accepted is, and the others are replays."""
    b = batches.select(F.col("id").alias("batch_id"), F.col("status").alias("batch_status"))
    a = attempts.select(F.col("id").alias("attempt_id"), "batch_id", F.col("status").alias("attempt_status"))
    rows = results.join(b, "batch_id", "left").join(a, ["attempt_id", "batch_id"], "left")
    may = (F.col("batch_status") == "RUNNING") & (F.col("attempt_status") == "RUNNING")
    first = rows.where(may).groupBy("batch_id").agg(F.min("attempt_id").alias("winner"))
    outcome = F.when(F.col("batch_status") == "ACCEPTED", "replay").when(F.coalesce(may, F.lit(False)), F.when(F.col("attempt_id") == F.col("winner"), "accepted").otherwise("replay")).otherwise("refused")
    return rows.join(first, "batch_id", "left").select(*results.columns, outcome.alias("outcome"))


def replace_or_replay(stored: DataFrame, incoming: DataFrame, group: str, explicit: bool = False) -> DataFrame:
    """(group, outcome) of writing whole groups: insert where nothing is stored, replace if that was asked for, same where
    both sides hold the same rows as often, and conflict otherwise."""
    columns = incoming.columns
    signed = stored.select(*columns, F.lit(1).alias("_s"), F.lit(0).alias("_i")).unionByName(incoming.select(*columns, F.lit(0).alias("_s"), F.lit(1).alias("_i")))
    rows = signed.groupBy(*columns).agg(F.sum("_s").alias("s"), F.sum("_i").alias("i"))
    per = rows.groupBy(group).agg(F.sum("s").alias("stored"), F.sum("i").alias("incoming"), F.bool_and(F.col("s") == F.col("i")).alias("same"))
    outcome = F.when(F.col("stored") == 0, "insert").when(F.lit(explicit), "replace").when(F.col("same"), "same").otherwise("conflict")
    return per.where("incoming > 0").select(group, outcome.alias("outcome"))


def replace_children(stored: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Stored rows of other parents, and all incoming ones: children are deleted and inserted anew."""
    return stored.join(incoming.select(parent).distinct(), parent, "left_anti").select(stored.columns).unionByName(incoming.select(stored.columns))


def cascade(tables: dict[str, tuple[DataFrame, str | None, str | None]], gone: DataFrame, root_key: str) -> dict[str, DataFrame]:
    """What is left of tables when the roots in ``gone`` go. A table is (rows, name of its parent table or None for a table
    that holds the root's key itself, key): children of tables that lose rows lose theirs, in the order given."""
    lost, left = {}, {}
    for name, (rows, parent, key) in tables.items():
        of = gone if parent is None else lost[parent]
        column = root_key if parent is None else key
        ids = of.select(F.col(root_key if parent is None else "id").alias(column)).distinct()
        lost[name], left[name] = rows.join(ids, column, "left_semi"), rows.join(ids, column, "left_anti").select(rows.columns)
    return left


def recovered(slots: DataFrame, tasks: DataFrame, batches: DataFrame, attempts: DataFrame, now: Column, startup: bool = False) -> dict[str, DataFrame]:
    """All four tables after claims are recovered: running batches whose lease is over, their running attempts and tasks
    go back to the queue, and slots are freed; at start-up also auditing tasks without a running batch."""
    holding = slots.where("task_id IS NOT NULL").select("task_id").distinct()
    over = batches.where((F.col("status") == "RUNNING") & (F.col("lease_expires_at") < now)).join(holding, "task_id", "left_semi")
    over = over.join(attempts.select(F.col("batch_id").alias("id")).distinct(), "id", "left_semi").select("task_id", F.col("id").alias("batch_id"))
    freed = over.select("task_id")
    if startup:
        idle = tasks.where("status = 'AUDITING'").join(holding, "task_id", "left_semi").join(batches.where("status = 'RUNNING'").select("task_id"), "task_id", "left_anti")
        freed = freed.unionByName(idle.select("task_id"))
    freed = freed.distinct().withColumn("_freed", F.lit(True))
    late = over.select(F.col("batch_id").alias("id"), F.lit(True).alias("_late")).distinct()
    hit, back = F.col("_freed").isNotNull(), F.col("_late").isNotNull()
    running = back & (F.col("status") == "RUNNING")
    return {
        "slots": slots.join(freed, "task_id", "left").withColumn("task_id", F.when(~hit, F.col("task_id"))).select(slots.columns),
        "tasks": tasks.join(freed, "task_id", "left").withColumn("status", F.when(hit, "QUEUED").otherwise(F.col("status"))).select(tasks.columns),
        "batches": batches.join(late, "id", "left").withColumns({"status": F.when(back, "QUEUED").otherwise(F.col("status")), "lease_expires_at": F.when(~back, F.col("lease_expires_at"))}).select(batches.columns),
        "attempts": attempts.join(late.withColumnRenamed("id", "batch_id"), "batch_id", "left").withColumn("status", F.when(running, "QUEUED").otherwise(F.col("status"))).select(attempts.columns),
    }


def cancelled(tasks: DataFrame, batches: DataFrame, requested: DataFrame) -> DataFrame:
    """(task_id, status, new_status, batches_cancelled): queued tasks among those requested are cancelled with their queued
    batches; running ones only at their next checkpoint, ended ones never."""
    asked = requested.select("task_id").distinct().withColumn("_asked", F.lit(True))
    queued = batches.where("status = 'QUEUED'").groupBy("task_id").agg(F.count("*").alias("k"))
    now = F.col("_asked").isNotNull() & (F.col("status") == "QUEUED")
    out = tasks.join(asked, "task_id", "left").join(queued, "task_id", "left")
    return out.select("task_id", "status", F.when(now, "CANCELLED").otherwise(F.col("status")).alias("new_status"), F.when(now, F.coalesce("k", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("batches_cancelled"))


def shown_flags(details: DataFrame) -> DataFrame:
    """What a viewer may do with each task of ``task_details``: cancel, retry, and which of five stages is active."""
    failed = F.col("failed") > 0
    s = F.col("status")
    active = (
        F.when(s.isin(TERMINAL), 4)
        .when(s.isin("GENERATING", "VALIDATING"), 3)
        .when(F.col("frozen_complete") | (F.col("business_stage") == "功能冻结"), 2)
        .when((F.col("business_stage") == "材料清单") | (s == "QUEUED"), 0)
        .otherwise(1)
    )
    reasons = F.array_join(F.transform(F.filter("batches", lambda b: (b["status"] == "FAILED") & (b["failure_summary"] != "")), lambda b: b["failure_summary"]), "；")
    return details.select("task_id", (~s.isin(TERMINAL)).alias("can_cancel"), failed.alias("has_failed_batch"), ((s == "FAILED") | (s == "PARTIAL") & failed).alias("can_retry"), ((s == "FAILED") & ~failed).alias("is_discovery_retry"), reasons.alias("batch_failures"), active.alias("active_stage"))


def created_once(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (task_id, idempotency_key) with the id that each gets and whether it is new: a key's stored task, or else
    the key's smallest request, is the task of all requests with the key. Requests without a key are tasks of their own."""
    known = stored.where("idempotency_key IS NOT NULL").select("idempotency_key", F.col("task_id").alias("stored_id"))
    first = requests.where("idempotency_key IS NOT NULL").groupBy("idempotency_key").agg(F.min("task_id").alias("first_id"))
    out = requests.join(known, "idempotency_key", "left").join(first, "idempotency_key", "left")
    own = F.coalesce("stored_id", "first_id", "task_id")
    return out.select("idempotency_key", F.col("task_id").alias("requested_id"), own.alias("task_id"), (F.col("stored_id").isNull() & (own == F.col("task_id"))).alias("is_new"))
