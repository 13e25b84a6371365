"""Queries that run the ledger's own operators over ledger-shaped tables, with DuckDB SQL for each.

The tables are made from the driver's: customers are tasks, orders are units, conclusions and batches, line items are
candidates, attempts and cases. FRAMES states each in SQL that Spark and DuckDB both read; the operators under test are
the library's on one side and plain SQL on the other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import ids as I
from ledgerloom.functions import text as X
from ledgerloom.functions import times as T
from ledgerloom.operators import ledger as L
from ledgerloom.operators.tables import parts_of, written
from ledgerloom.plans import progress as P
from ledgerloom.plans import reconcile as R
from ledgerloom.plans import review as V
from ledgerloom.plans import scope as S
from ledgerloom.plans import tasks as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col
big = lambda x: x.cast("bigint")

#: each in SQL over the driver's tables and frames before it, whose names are in braces
FRAMES = {
    "lines": "SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_returnflag) AS flag FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
    "tasks": """SELECT 'T' || c_custkey AS task_id, c_custkey AS created, CASE WHEN c_custkey % 4 = 0 THEN 'FEATURE' ELSE 'ALL' END AS mode,
        CASE c_custkey % 8 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'AUDITING' WHEN 2 THEN 'GENERATING' WHEN 3 THEN 'VALIDATING' WHEN 4 THEN 'COMPLETED' WHEN 5 THEN 'PARTIAL' WHEN 6 THEN 'FAILED' ELSE 'CANCELLED' END AS status,
        1 + c_custkey % 2 AS material_documents, CASE WHEN c_custkey % 5 > 0 THEN 'A' || c_custkey END AS artifact_id, CASE WHEN c_custkey % 9 = 0 THEN 'no result' END AS result_failure FROM {customer}""",
    "inventory": "SELECT task_id, task_id || '-D' || k AS document_id, NOT (created % 11 = 0 AND k = 2) AS complete FROM {tasks} CROSS JOIN (VALUES (1), (2)) AS v(k) WHERE k <= material_documents",
    "units": """SELECT 'T' || o_custkey AS task_id, 'T' || o_custkey || '-D' || (1 + o_orderkey % (1 + o_custkey % 2)) AS document_id, 'U' || o_orderkey AS unit_id,
        CASE WHEN o_orderkey % (1 + o_custkey % 2) = 0 THEN 'FUNCTION_LIST' ELSE 'REQUIREMENT' END AS role, o_orderkey, o_custkey, o_orderstatus FROM {orders}""",
    "work": """SELECT task_id, document_id, unit_id, CASE WHEN role = 'FUNCTION_LIST' THEN 'FEATURE_LIST_SCAN' ELSE 'REQUIREMENT_SCAN' END AS audit_stage, k AS audit_pass,
        CASE WHEN o_custkey % 3 > 0 OR o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'QUEUED' END AS status
        FROM {units} CROSS JOIN (VALUES (1), (2)) AS v(k) WHERE k = 1 OR role <> 'FUNCTION_LIST'""",
    "candidates": """SELECT u.task_id, u.document_id, u.unit_id, 'C' || l_orderkey || '-' || l_linenumber AS occurrence_id, l_orderkey * 10 + l_linenumber AS position, o_custkey, l_orderkey, l_linenumber,
        CASE WHEN part % 17 = 0 THEN ' ' ELSE ' Area ' || (part % 3) || ' /  Leaf ' || (supp % 4) END AS feature_text, flag AS category,
        'documentId=' || u.document_id || '; unitId=' || u.unit_id || CASE WHEN part % 2 = 0 THEN '; line ' || l_linenumber ELSE '' END AS evidence_text, part, supp
        FROM {lines} JOIN {units} AS u ON o_orderkey = l_orderkey""",
    "links": "SELECT task_id, 'K' || l_orderkey AS conclusion_id, occurrence_id AS candidate_id FROM {candidates} WHERE NOT (o_custkey % 13 = 0 AND l_linenumber = 1)",
    "conclusions": """SELECT task_id, 'K' || o_orderkey AS id,
        CASE o_orderkey % 8 WHEN 1 THEN 'FUNCTION_LIST_MISSING' WHEN 2 THEN 'REQUIREMENT_MISSING' WHEN 3 THEN CASE WHEN o_custkey % 7 = 0 THEN 'CONFLICT' ELSE 'MATCHED' END
          WHEN 4 THEN 'SPLIT' WHEN 5 THEN 'MERGE' WHEN 6 THEN 'DUPLICATE' WHEN 7 THEN CASE WHEN o_custkey % 2 = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'MATCHED' END ELSE 'MATCHED' END AS conclusion_type,
        CASE WHEN o_orderkey % 8 = 4 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'Only one' ELSE 'Area ' || o_orderkey || '/One<br>Area ' || o_orderkey || '/Two' END
          WHEN o_orderkey % 97 = 1 THEN ' ' WHEN o_orderkey % 97 = 2 THEN 'Area/<b>bold</b>' WHEN o_orderkey % 97 = 3 THEN 'Same/Path' ELSE 'Area ' || o_orderkey || ' / Leaf' END AS explanation FROM {units}""",
    "batches": """SELECT 'B' || o_orderkey AS id, task_id, o_orderkey AS batch_sequence, 'F' || o_orderkey AS feature_id,
        CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' WHEN 'P' THEN 'FAILED' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' ELSE 'CANCELLED' END END AS status,
        CASE WHEN o_orderstatus = 'O' THEN o_orderkey % 100 END AS lease_expires_at FROM {units} WHERE o_custkey % 19 > 0""",
    "attempts": """SELECT 'X' || l_orderkey || '-' || l_linenumber AS id, 'B' || l_orderkey AS batch_id, l_linenumber AS attempt_number, CASE flag WHEN 'R' THEN 'FAILED' WHEN 'A' THEN 'COMPLETED' ELSE 'RUNNING' END AS status,
        CASE WHEN flag = 'R' THEN 'reason ' || (part % 5) END AS failure_reason, supp % 3 > 0 AS retryable FROM {lines}""",
    "cases": "SELECT 'B' || l_orderkey AS batch_id, l_linenumber AS row_sequence FROM {lines} WHERE l_linenumber <= 2 OR part % 10 = 0",
    "targets": "SELECT task_id, 'F' || o_orderkey AS stable_feature_id, o_custkey % 3 = 0 OR o_orderkey % 8 <> 7 AS generation_eligible FROM {units} WHERE o_custkey % 19 > 0",
    "slots": "SELECT s_suppkey AS slot, CASE WHEN s_suppkey % 4 > 0 THEN 'T' || (s_suppkey * 3) END AS task_id FROM {supplier}",
    "judged": """SELECT task_id, occurrence_id, CASE WHEN part % 23 = 0 THEN 'SPLIT' WHEN part % 3 = 0 THEN 'MATCHED' ELSE 'MERGE' END AS type, CASE WHEN part % 29 = 0 THEN 'Other/Path' ELSE 'Area ' || (part % 3) || ' / Leaf ' || (supp % 4) END AS explanation,
        evidence_text || '; candidateIds=' || occurrence_id || '; groupAnchorId=' || occurrence_id AS evidence FROM {candidates}""",
}
DRIVER = {t: t for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()}
WITH = "WITH " + ", ".join(f"{name} AS ({sql.format_map(DRIVER | dict.fromkeys(FRAMES) | {n: n for n in FRAMES})})" for name, sql in FRAMES.items())


class Tables:
    """The driver's tables and the frames made from them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in FRAMES:
                needs = {n: self(n) for n in [*FRAMES, *DRIVER] if f"{{{n}}}" in FRAMES[name]}
                if name == "lines":
                    # dealt out by order before anything is sorted: repeats meet, and joins and windows by order find them there
                    needs["lineitem"] = needs["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").repartition(self.parts, "l_orderkey")
                self.made[name] = self.spark.sql(FRAMES[name], **needs)
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]

    @cached_property
    def parts(self) -> int:
        """Parts of the line items, and of frames that have as many rows."""
        return parts_of(self("lineitem"))

    def keep(self, *names: str) -> Tables:
        """Writes frames that a query reads many times, once."""
        for name in names:
            self.made[name] = written(self(name), name)
        return self


def query(sql: str | None, frames: bool = True) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = f"{WITH}{',' if sql.lstrip().startswith(',') else ' '}{sql.lstrip().removeprefix(',')}" if frames else sql
        return f

    return add


# Progress, details and gates

_PROGRESS = """, per AS (SELECT t.task_id, mode, status, material_documents AS docs,
    (SELECT count(*) FROM inventory i WHERE i.task_id = t.task_id AND complete) AS complete_documents, (SELECT count(*) FROM units u WHERE u.task_id = t.task_id) AS total_units,
    (SELECT count(*) FROM (SELECT unit_id FROM work w WHERE w.task_id = t.task_id GROUP BY document_id, unit_id HAVING bool_and(w.status = 'COMPLETED'))) AS processed_units,
    (SELECT count(*) FROM work w WHERE w.task_id = t.task_id) AS total_work, (SELECT count(*) FROM work w WHERE w.task_id = t.task_id AND w.status = 'COMPLETED') AS completed_work,
    (SELECT count(*) FROM work w WHERE w.task_id = t.task_id AND w.status = 'FAILED') AS failed_work,
    (SELECT count(*) FROM work w WHERE w.task_id = t.task_id AND w.status <> 'COMPLETED' AND audit_stage = 'FEATURE_LIST_SCAN') AS p0,
    (SELECT count(*) FROM work w WHERE w.task_id = t.task_id AND w.status <> 'COMPLETED' AND audit_stage = 'REQUIREMENT_SCAN' AND audit_pass = 1) AS p1,
    (SELECT count(*) FROM work w WHERE w.task_id = t.task_id AND w.status <> 'COMPLETED' AND audit_stage = 'REQUIREMENT_SCAN' AND audit_pass = 2) AS p2,
    (SELECT count(*) FROM candidates x WHERE x.task_id = t.task_id) AS candidates, (SELECT count(*) FROM links x WHERE x.task_id = t.task_id) AS covered,
    (SELECT count(DISTINCT x.conclusion_id) FROM links x JOIN conclusions k ON k.id = x.conclusion_id WHERE x.task_id = t.task_id AND conclusion_type = 'CONFLICT') AS conflicts,
    (SELECT count(DISTINCT x.conclusion_id) FROM links x JOIN conclusions k ON k.id = x.conclusion_id WHERE x.task_id = t.task_id AND conclusion_type = 'SPLIT') AS splits,
    (SELECT count(*) FROM targets x WHERE x.task_id = t.task_id) AS frozen, (SELECT count(*) FROM targets x WHERE x.task_id = t.task_id AND generation_eligible) AS eligible,
    (SELECT count(*) FROM cases JOIN batches b ON b.id = batch_id WHERE b.task_id = t.task_id AND b.status = 'ACCEPTED') AS accepted_cases FROM tasks t),
  done AS (SELECT *, mode = 'ALL' AND complete_documents = docs AND total_units > 0 AND total_work > 0 AND total_work = completed_work AND candidates > 0 AND candidates = covered AND conflicts = 0 AND frozen > 0 AS ok FROM per)"""


@query(
    _PROGRESS
    + """ SELECT task_id, complete_documents, total_units, processed_units, total_work, completed_work, failed_work, p0 AS pending_function_list, p1 AS pending_requirement_first_pass, p2 AS pending_requirement_second_pass,
  candidates, covered AS covered_candidates, conflicts, splits, accepted_cases, ok AS frozen_complete, CASE WHEN ok THEN frozen END AS frozen_features, CASE WHEN ok THEN eligible * 2 END AS expected_cases,
  CASE status WHEN 'QUEUED' THEN '排队等待' WHEN 'GENERATING' THEN '测试用例生成' WHEN 'VALIDATING' THEN '结果校验' WHEN 'COMPLETED' THEN '已完成' WHEN 'PARTIAL' THEN '部分完成' WHEN 'FAILED' THEN '已失败' WHEN 'CANCELLED' THEN '已取消'
    ELSE CASE WHEN complete_documents < docs THEN '材料清单' WHEN p0 > 0 THEN '功能清单扫描' WHEN p1 > 0 THEN '需求扫描（第一遍）' WHEN p2 > 0 THEN '需求扫描（第二遍）' WHEN candidates <> covered THEN '双向核对' WHEN ok THEN '功能冻结' ELSE '审查收敛' END END AS business_stage,
  CASE WHEN status = 'COMPLETED' THEN '完整' WHEN status = 'PARTIAL' OR status = 'FAILED' AND ok THEN '审查完整但用例不完整' WHEN status = 'FAILED' THEN '材料或审查失败' WHEN status = 'CANCELLED' THEN '已取消' ELSE '进行中' END AS coverage_status FROM done"""
)
def task_progress(t: Tables) -> DataFrame:
    return _progress(t).select("task_id", *PROGRESS_COLUMNS)


PROGRESS_COLUMNS = "complete_documents total_units processed_units total_work completed_work failed_work pending_function_list pending_requirement_first_pass pending_requirement_second_pass candidates covered_candidates conflicts splits accepted_cases frozen_complete frozen_features expected_cases business_stage coverage_status".split()


def _progress(t: Tables) -> DataFrame:
    return P.progress(t("tasks"), t("inventory"), t("units"), t("work"), t("candidates"), t("links"), t("conclusions"), t("targets"), t("batches"), t("cases"))


_LATEST = ", latest AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY attempt_number DESC) = 1)"
_SUMMARY = _LATEST + ", summary AS (SELECT b.task_id, arg_min(failure_reason, batch_sequence) AS failure FROM batches b JOIN latest a ON a.batch_id = b.id WHERE b.status = 'FAILED' AND failure_reason IS NOT NULL GROUP BY 1)"
_COUNTS = ", counts AS (SELECT task_id, count(*) AS total, count(*) FILTER (status IN ('ACCEPTED', 'FAILED', 'CANCELLED')) AS completed, count(*) FILTER (status = 'ACCEPTED') AS accepted, count(*) FILTER (status = 'FAILED') AS failed FROM batches GROUP BY 1)"


@query(
    _SUMMARY
    + _COUNTS
    + """ SELECT t.task_id, coalesce(total, 0) AS total, coalesce(completed, 0) AS completed, coalesce(failure, result_failure) AS failure_summary, artifact_id IS NOT NULL AS artifact_ready,
  (SELECT count(*) FROM cases JOIN batches b ON b.id = batch_id WHERE b.task_id = t.task_id AND b.status = 'ACCEPTED') AS accepted_rows,
  (SELECT string_agg(b.id || ' ' || b.status || coalesce(' ' || CASE WHEN b.status = 'FAILED' THEN failure_reason END, ''), ',' ORDER BY batch_sequence) FROM batches b LEFT JOIN latest a ON a.batch_id = b.id WHERE b.task_id = t.task_id) AS batches
  FROM tasks t LEFT JOIN counts USING (task_id) LEFT JOIN summary USING (task_id)"""
)
def task_details(t: Tables) -> DataFrame:
    out = K.task_details(t("tasks"), t("batches"), t("attempts"), t("cases"))
    shown = F.array_join(F.transform("batches", lambda b: F.concat_ws(" ", b["batch_id"], b["status"], b["failure_summary"])), ",")
    return out.select("task_id", "total", "completed", "failure_summary", "artifact_ready", "accepted_rows", shown.alias("batches"))


@query(
    _SUMMARY
    + _COUNTS
    + """, found AS (SELECT * FROM tasks WHERE lower(task_id) LIKE '%t1%' AND status = 'FAILED') SELECT task_id, mode, status, created, coalesce(total, 0) AS total_batches, coalesce(completed, 0) AS completed_batches,
  coalesce(failure, result_failure) AS failure_summary, artifact_id IS NOT NULL AS artifact_ready, (SELECT count(*) FROM found) AS total_items, (SELECT CAST(greatest(1, ceil(count(*) / 5)) AS BIGINT) FROM found) AS pages
  FROM (SELECT * FROM found ORDER BY created DESC, task_id DESC LIMIT 5 OFFSET 5) LEFT JOIN counts USING (task_id) LEFT JOIN summary USING (task_id)"""
)
def task_page(t: Tables) -> DataFrame:
    return K.task_page(t("tasks"), t("batches"), t("attempts"), 1, 5, " T1", "FAILED")


_FROZEN = """, heads AS (SELECT k.*, (SELECT list_sort(list(candidate_id)) FROM links l WHERE l.conclusion_id = k.id) AS ids FROM conclusions k),
  parts AS (SELECT *, trim(unnest(CASE WHEN conclusion_type = 'SPLIT' THEN string_split(explanation, '<br>') ELSE [explanation] END)) AS path, CASE WHEN conclusion_type = 'SPLIT' THEN len(string_split(explanation, '<br>')) ELSE 1 END AS n FROM heads),
  normal AS (SELECT *, lower(regexp_replace(path, '\\s+', ' ', 'g')) AS norm, CASE WHEN conclusion_type = 'SPLIT' AND n < 2 THEN 'a split needs two paths' WHEN path = '' THEN 'a blank path' WHEN contains(path, '<') THEN 'a path with markup' END AS error FROM parts),
  ids AS (SELECT *, 'ff-' || sha256(array_to_string(ids, chr(31)) || chr(31) || norm) AS stable_feature_id FROM normal WHERE error IS NULL AND ids IS NOT NULL)"""


def _heads(t: Tables) -> DataFrame:
    own = t("links").groupBy(c("conclusion_id").alias("id")).agg(F.array_sort(F.collect_list("candidate_id")).alias("candidate_ids"))
    return t("conclusions").join(own, "id")


@query(_FROZEN + """ SELECT task_id, stable_feature_id, path AS feature_name, conclusion_type <> 'INSUFFICIENT_EVIDENCE' AS generation_eligible, row_number() OVER (PARTITION BY task_id ORDER BY stable_feature_id) AS stable_sequence, id AS conclusion_id,
  substr(h,1,8) || '-' || substr(h,9,4) || '-3' || substr(h,14,3) || '-' || substr('89ab', 1 + (instr('0123456789abcdef', substr(h,17,1)) - 1) % 4, 1) || substr(h,18,3) || '-' || substr(h,21,12) AS id FROM (SELECT *, md5(task_id || chr(31) || stable_feature_id) AS h FROM ids)""")
def frozen_targets(t: Tables) -> DataFrame:
    targets, _ = V.freeze(t("candidates"), _heads(t))
    return targets.select("task_id", "stable_feature_id", "feature_name", "generation_eligible", big(c("stable_sequence")).alias("stable_sequence"), c("source.conclusion_id").alias("conclusion_id"), "id")


@query(
    _FROZEN
    + """ SELECT 'conflict' AS rule, id AS key, 'unresolved' AS detail FROM heads WHERE conclusion_type = 'CONFLICT' AND ids IS NOT NULL UNION ALL SELECT 'path', id, error FROM normal WHERE error IS NOT NULL AND ids IS NOT NULL
  UNION ALL SELECT 'distinct path', task_id || '|' || norm, CAST(count(*) AS VARCHAR) FROM ids GROUP BY task_id, norm HAVING count(*) > 1
  UNION ALL SELECT 'one conclusion', task_id || '|' || occurrence_id, 'missing' FROM candidates WHERE occurrence_id NOT IN (SELECT candidate_id FROM links)"""
)
def freeze_violations(t: Tables) -> DataFrame:
    return V.freeze(t("candidates"), _heads(t))[1]


@query(_FROZEN + ", frozen AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY stable_feature_id) AS seq FROM ids) SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS batch_sequence, stable_feature_id AS feature_id, path AS feature_name FROM frozen WHERE conclusion_type <> 'INSUFFICIENT_EVIDENCE'")
def planned_batches(t: Tables) -> DataFrame:
    return V.plan_batches(V.freeze(t("candidates"), _heads(t))[0]).withColumn("batch_sequence", big(c("batch_sequence")))


def _gate(t: Tables) -> DataFrame:
    # the heads are written, not the targets: these are made of them row by row, and each check deals out what it needs
    targets, _ = V.freeze(t("candidates"), written(_heads(t), "heads"))
    return K.audit_gate(t("tasks"), t("inventory"), t("work"), t("candidates"), t("conclusions"), t("links"), targets.select("task_id", "stable_feature_id", "stable_sequence", "generation_eligible", "source.*"))


_GATE = (
    _PROGRESS
    + _FROZEN
    + """, head AS (SELECT task_id, count(*) AS n, count(*) FILTER (conclusion_type = 'CONFLICT') AS conflicted FROM conclusions GROUP BY 1),
  tgt AS (SELECT task_id, count(*) AS n, count(DISTINCT stable_feature_id) AS d, count(DISTINCT id) AS k, count(*) FILTER (conclusion_type = 'CONFLICT') AS bad FROM ids GROUP BY 1),
  lost AS (SELECT task_id, count(*) AS n FROM candidates WHERE occurrence_id NOT IN (SELECT unnest(ids) FROM ids) GROUP BY 1),
  gate AS (SELECT p.task_id, CASE WHEN docs = 0 OR complete_documents <> docs THEN 'inventory' WHEN total_work = 0 OR total_work <> completed_work OR failed_work > 0 THEN 'audit work' WHEN candidates = 0 OR candidates <> covered THEN 'candidate coverage'
    WHEN coalesce(tgt.n, 0) = 0 THEN 'no targets' WHEN coalesce(head.n, 0) = 0 THEN 'conclusions' WHEN tgt.d <> tgt.n THEN 'target numbering' WHEN tgt.bad > 0 THEN 'targets against conclusions' WHEN tgt.k <> head.n THEN 'conclusions without a target'
    WHEN coalesce(lost.n, 0) > 0 THEN 'targets against candidates' WHEN head.conflicted > 0 THEN 'conflicts' END AS reason FROM per p LEFT JOIN head USING (task_id) LEFT JOIN tgt USING (task_id) LEFT JOIN lost USING (task_id))"""
)


@query(_GATE + " SELECT task_id, reason IS NULL AS complete, reason FROM gate")
def audit_gate(t: Tables) -> DataFrame:
    return _gate(t)


@query(
    _GATE.replace(_FROZEN, _FROZEN + _LATEST + _COUNTS)
    + """, per_batch AS (SELECT b.task_id, b.feature_id, (SELECT count(*) FROM cases WHERE batch_id = b.id) AS k FROM batches b WHERE status = 'ACCEPTED'),
  rows_of AS (SELECT task_id, count(*) FILTER (k <> 2) AS not_two, sum(k) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM targets g WHERE g.task_id = per_batch.task_id AND stable_feature_id = feature_id AND generation_eligible)) AS af FROM per_batch GROUP BY 1),
  final_lost AS (SELECT b.task_id, count(*) AS lost FROM batches b JOIN latest a ON a.batch_id = b.id WHERE b.status = 'FAILED' AND (NOT retryable OR attempt_number >= 3) GROUP BY 1),
  tg AS (SELECT task_id, count(*) FILTER (generation_eligible) AS e, count(*) FILTER (NOT generation_eligible) AS i FROM targets GROUP BY 1),
  j AS (SELECT t.task_id, mode, coalesce(total, 0) AS total, coalesce(completed, 0) AS completed, coalesce(accepted, 0) AS accepted, coalesce(failed, 0) AS failed, coalesce(e, 0) AS e, coalesce(i, 0) AS i, coalesce(not_two, 0) = 0 AND coalesce(n, 0) = 2 * coalesce(accepted, 0) AS exact,
    coalesce(af, 0) AS af, coalesce(lost, 0) AS lost, gate.reason IS NULL AS ok FROM tasks t LEFT JOIN counts USING (task_id) LEFT JOIN tg USING (task_id) LEFT JOIN rows_of USING (task_id) LEFT JOIN final_lost USING (task_id) LEFT JOIN gate USING (task_id)),
  f AS (SELECT task_id, CASE WHEN mode = 'FEATURE' THEN CASE WHEN accepted = 0 THEN 'FAILED' WHEN failed > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END WHEN NOT ok THEN 'FAILED' WHEN i = 0 AND total = e AND completed = e AND accepted = e AND af = e AND exact THEN 'COMPLETED'
    WHEN (i > 0 OR lost > 0) AND total = e AND completed = e AND af = accepted AND accepted + lost = e AND accepted > 0 AND exact THEN 'PARTIAL' ELSE 'FAILED' END AS terminal FROM j)
  SELECT task_id, terminal, terminal <> 'FAILED' AS exportable FROM f"""
)
def finalization(t: Tables) -> DataFrame:
    return K.finalization(t("tasks"), t("batches"), t("attempts"), t("cases"), t("targets"), _gate(t))


@query(_PROGRESS + _COUNTS + _LATEST + """ SELECT d.task_id, d.status NOT IN ('COMPLETED','PARTIAL','FAILED','CANCELLED') AS can_cancel, coalesce(failed, 0) > 0 AS has_failed_batch, d.status = 'FAILED' OR d.status = 'PARTIAL' AND coalesce(failed, 0) > 0 AS can_retry,
  d.status = 'FAILED' AND coalesce(failed, 0) = 0 AS is_discovery_retry, CASE WHEN total IS NOT NULL THEN coalesce((SELECT string_agg(failure_reason, '；' ORDER BY batch_sequence) FROM batches b JOIN latest a ON a.batch_id = b.id WHERE b.task_id = d.task_id AND b.status = 'FAILED'), '') END AS batch_failures,
  CASE WHEN d.status IN ('COMPLETED','PARTIAL','FAILED','CANCELLED') THEN 4 WHEN d.status IN ('GENERATING','VALIDATING') THEN 3 WHEN ok THEN 2 WHEN d.status = 'QUEUED' OR complete_documents < docs THEN 0 WHEN p0 + p1 + p2 = 0 AND candidates = covered AND ok THEN 2 ELSE 1 END AS active_stage
  FROM done d LEFT JOIN counts USING (task_id)""")
def viewer_flags(t: Tables) -> DataFrame:
    details = K.task_details(t("tasks"), t("batches"), t("attempts"), t("cases"))
    return K.shown_flags(details.join(_progress(t).select("task_id", "frozen_complete", "business_stage"), "task_id"))


# Retries, acceptance, recovery and replacement


@query(_LATEST + " SELECT b.task_id, b.id AS batch_id, batch_sequence, CAST(attempt_number + 1 AS BIGINT) AS next_attempt FROM batches b JOIN latest a ON a.batch_id = b.id WHERE b.status = 'FAILED' AND retryable AND attempt_number < 3")
def retry_selection(t: Tables) -> DataFrame:
    return K.retries(t("batches"), t("attempts")).withColumn("next_attempt", big(c("next_attempt")))


@query(_LATEST + """, n AS (SELECT b.task_id, count(*) AS k FROM batches b JOIN latest a ON a.batch_id = b.id WHERE b.status = 'FAILED' AND retryable AND attempt_number < 3 GROUP BY 1),
  w AS (SELECT t.*, coalesce(k, 0) AS k, k IS NULL AND status = 'FAILED' AND mode = 'ALL' AND task_id NOT IN (SELECT task_id FROM batches) AS whole FROM tasks t LEFT JOIN n USING (task_id))
  SELECT task_id, status, CASE WHEN k > 0 AND status IN ('PARTIAL', 'FAILED') OR whole THEN 'QUEUED' ELSE status END AS new_status, k + CASE WHEN whole THEN 1 ELSE 0 END AS retried, k > 0 AND status IN ('PARTIAL', 'FAILED') AS clears_artifact FROM w""")
def requeued_tasks(t: Tables) -> DataFrame:
    return K.requeued(t("tasks"), t("batches"), t("attempts"))


@query(""", r AS (SELECT 'B' || l_orderkey AS batch_id, 'X' || (l_orderkey + CASE WHEN part % 7 = 0 THEN 1 ELSE 0 END) || '-' || l_linenumber AS attempt_id FROM lines WHERE l_linenumber <= 3),
  j AS (SELECT r.*, b.status AS bs, b.status = 'RUNNING' AND a.status = 'RUNNING' AS may FROM r LEFT JOIN batches b ON b.id = r.batch_id LEFT JOIN attempts a ON a.id = r.attempt_id AND a.batch_id = r.batch_id)
  SELECT batch_id, attempt_id, CASE WHEN bs = 'ACCEPTED' THEN 'replay' WHEN may THEN CASE WHEN attempt_id = min(attempt_id) FILTER (may) OVER (PARTITION BY batch_id) THEN 'accepted' ELSE 'replay' END ELSE 'refused' END AS outcome FROM j""")
def exactly_once_acceptance(t: Tables) -> DataFrame:
    shifted = c("l_orderkey") + F.when(c("part") % 7 == 0, 1).otherwise(0)
    results = t("lines").where("l_linenumber <= 3").select(F.concat(F.lit("B"), "l_orderkey").alias("batch_id"), F.concat(F.lit("X"), shifted, F.lit("-"), "l_linenumber").alias("attempt_id"))
    return K.acceptance(t("batches"), t("attempts"), results)


@query(""", stored AS (SELECT task_id, document_id, complete FROM inventory WHERE task_id NOT LIKE '%3'), incoming AS (SELECT task_id, document_id, CASE WHEN task_id LIKE '%5' THEN NOT complete ELSE complete END AS complete FROM inventory WHERE NOT (task_id LIKE '%7' AND document_id LIKE '%D2'))
  SELECT i.task_id, CASE WHEN s.rows IS NULL THEN 'insert' WHEN s.rows = i.rows THEN 'same' ELSE 'conflict' END AS outcome FROM (SELECT task_id, list_sort(list(document_id || complete)) AS rows FROM incoming GROUP BY 1) i LEFT JOIN (SELECT task_id, list_sort(list(document_id || complete)) AS rows FROM stored GROUP BY 1) s USING (task_id)""")
def inventory_replay(t: Tables) -> DataFrame:
    stored = t("inventory").where("task_id NOT LIKE '%3'")
    incoming = t("inventory").withColumn("complete", F.when(c("task_id").endswith("5"), ~c("complete")).otherwise(c("complete"))).where("NOT (task_id LIKE '%7' AND document_id LIKE '%D2')")
    return K.replace_or_replay(stored, incoming, "task_id")


@query(", incoming AS (SELECT batch_id, row_sequence + 10 AS row_sequence FROM cases WHERE batch_id LIKE '%7') SELECT batch_id, row_sequence FROM cases WHERE batch_id NOT IN (SELECT batch_id FROM incoming) UNION ALL SELECT * FROM incoming")
def replaced_children(t: Tables) -> DataFrame:
    return K.replace_children(t("cases"), t("cases").where("batch_id LIKE '%7'").withColumn("row_sequence", c("row_sequence") + 10), "batch_id")


@query(""", gone AS (SELECT task_id FROM tasks WHERE status = 'CANCELLED'), b AS (SELECT id FROM batches WHERE task_id IN (SELECT task_id FROM gone))
  SELECT 'tasks' AS name, count(*) AS n FROM tasks WHERE task_id NOT IN (SELECT task_id FROM gone) UNION ALL SELECT 'batches', count(*) FROM batches WHERE task_id NOT IN (SELECT task_id FROM gone)
  UNION ALL SELECT 'attempts', count(*) FROM attempts WHERE batch_id NOT IN (SELECT id FROM b) UNION ALL SELECT 'cases', count(*) FROM cases WHERE batch_id NOT IN (SELECT id FROM b) UNION ALL SELECT 'candidates', count(*) FROM candidates WHERE task_id NOT IN (SELECT task_id FROM gone)""")
def cascading_delete(t: Tables) -> DataFrame:
    tables = {"tasks": (t("tasks"), None, None), "batches": (t("batches"), None, None), "attempts": (t("attempts"), "batches", "batch_id"), "cases": (t("cases"), "batches", "batch_id"), "candidates": (t("candidates"), None, None)}
    left = K.cascade(tables, t("tasks").where("status = 'CANCELLED'"), "task_id")
    out = None
    for name, df in left.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(""", held AS (SELECT DISTINCT task_id FROM slots WHERE task_id IS NOT NULL), late AS (SELECT id, task_id FROM batches WHERE status = 'RUNNING' AND lease_expires_at < 50 AND task_id IN (SELECT task_id FROM held) AND id IN (SELECT batch_id FROM attempts)),
  freed AS (SELECT task_id FROM late UNION SELECT task_id FROM tasks WHERE status = 'AUDITING' AND task_id IN (SELECT task_id FROM held) AND task_id NOT IN (SELECT task_id FROM batches WHERE status = 'RUNNING'))
  SELECT 'slots' AS name, CAST(slot AS VARCHAR) AS key, CASE WHEN task_id NOT IN (SELECT task_id FROM freed) THEN task_id END AS value FROM slots UNION ALL SELECT 'tasks', task_id, CASE WHEN task_id IN (SELECT task_id FROM freed) THEN 'QUEUED' ELSE status END FROM tasks
  UNION ALL SELECT 'batches', id, CASE WHEN id IN (SELECT id FROM late) THEN 'QUEUED' ELSE status END FROM batches UNION ALL SELECT 'attempts', id, CASE WHEN status = 'RUNNING' AND batch_id IN (SELECT id FROM late) THEN 'QUEUED' ELSE status END FROM attempts""")
def recovered_claims(t: Tables) -> DataFrame:
    out = K.recovered(t("slots"), t("tasks"), t("batches"), t("attempts"), F.lit(50), startup=True)
    keys = {"slots": ("slot", "task_id"), "tasks": ("task_id", "status"), "batches": ("id", "status"), "attempts": ("id", "status")}
    rows = [out[n].select(F.lit(n).alias("name"), c(k).cast("string").alias("key"), c(v).alias("value")) for n, (k, v) in keys.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(", asked AS (SELECT task_id FROM tasks WHERE created % 3 = 0) SELECT task_id, status, CASE WHEN a THEN 'CANCELLED' ELSE status END AS new_status, CASE WHEN a THEN (SELECT count(*) FROM batches b WHERE b.task_id = t.task_id AND b.status = 'QUEUED') ELSE 0 END AS batches_cancelled FROM (SELECT *, status = 'QUEUED' AND task_id IN (SELECT task_id FROM asked) AS a FROM tasks) t")
def cancelled_tasks(t: Tables) -> DataFrame:
    return K.cancelled(t("tasks"), t("batches"), t("tasks").where("created % 3 = 0"))


@query(" SELECT task_id, status, mode FROM tasks WHERE task_id = 'T7'")
def point_lookup(t: Tables) -> DataFrame:
    return K.lookup(t("tasks").select("task_id", "status", "mode"), c("task_id") == "T7", "task T7")


@query(" SELECT task_id, document_id, unit_id, audit_stage, CAST(audit_pass AS BIGINT) AS audit_pass, substr(h,1,8) || '-' || substr(h,9,4) || '-3' || substr(h,14,3) || '-' || substr('89ab', 1 + (instr('0123456789abcdef', substr(h,17,1)) - 1) % 4, 1) || substr(h,18,3) || '-' || substr(h,21,12) AS id FROM (SELECT *, md5(task_id || ':' || document_id || ':' || unit_id || ':' || audit_pass || ':' || audit_stage) AS h FROM work)")
def opened_work(t: Tables) -> DataFrame:
    return S.open_work(t("units")).select("task_id", "document_id", "unit_id", "audit_stage", big(c("audit_pass")).alias("audit_pass"), "id")


# Reconciliation

_PAGES = """, idx AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY position, occurrence_id) - 1 AS i, CASE WHEN trim(feature_text) = '' THEN chr(0) || occurrence_id ELSE lower(regexp_replace(trim(feature_text), '\\s+', ' ', 'g')) END AS path FROM candidates),
  paged AS (SELECT *, i // 8 + 1 AS page FROM idx),
  groups AS (SELECT task_id, page, path, arg_min(occurrence_id, i) AS representative, min(i) AS first, string_agg(occurrence_id, ',' ORDER BY i) AS members FROM paged GROUP BY 1, 2, 3)"""


@query(_PAGES + " SELECT task_id, page, CASE WHEN starts_with(path, chr(0)) THEN 'none' ELSE path END AS path, representative, members, row_number() OVER (PARTITION BY task_id, page ORDER BY first) AS group_number FROM groups")
def reconciliation_groups(t: Tables) -> DataFrame:
    out = R.groups(R.pages(t("candidates")))
    return out.select("task_id", big(c("page")).alias("page"), F.when(c("path").startswith("\x00"), "none").otherwise(c("path")).alias("path"), "representative", F.array_join("members", ",").alias("members"), big(c("group_number")).alias("group_number"))


_SETTLED = (
    _PAGES
    + """, own AS (SELECT g.*, type, explanation, evidence, type <> 'SPLIT' AND lower(regexp_replace(trim(explanation), '\\s+', ' ', 'g')) = path AS keeps FROM groups g JOIN judged j ON j.occurrence_id = representative),
  firsts AS (SELECT * FROM own WHERE keeps QUALIFY row_number() OVER (PARTITION BY task_id, path ORDER BY page) = 1),
  settled AS (SELECT o.task_id, o.page, o.path, coalesce(f.page < o.page, false) AS reused, CASE WHEN f.page < o.page THEN f.representative ELSE o.representative END AS source_id, CASE WHEN f.page < o.page THEN f.type ELSE o.type END AS type,
    CASE WHEN f.page < o.page THEN f.explanation ELSE o.explanation END AS explanation FROM own o LEFT JOIN firsts f USING (task_id, path)),
  projected AS (SELECT p.task_id, p.i, p.occurrence_id, type, explanation, source_id, reused, 'documentId=' || document_id || '; unitId=' || unit_id || '; candidateIds=' || occurrence_id || '; groupAnchorId=' || source_id || CASE WHEN part % 2 = 0 THEN '; line ' || l_linenumber ELSE '' END AS evidence FROM paged p JOIN settled s USING (task_id, page, path))"""
)


def _projected(t: Tables) -> DataFrame:
    # of the evidence the anchor alone is bound to candidates, and it alone is dealt out
    judged = t.keep("lines")("judged").withColumn("evidence", F.concat(F.lit("groupAnchorId="), R.anchor(c("evidence"))))
    return R.bound(R.concluded(t("candidates"), judged))


@query(_SETTLED + " SELECT occurrence_id, type, explanation, source_id, evidence FROM projected")
def projected_conclusions(t: Tables) -> DataFrame:
    return _projected(t).select("occurrence_id", "type", "explanation", "source_id", "evidence")


@query(_SETTLED + " SELECT task_id, count(*) FILTER (reused) AS reused, count(*) AS groups FROM settled GROUP BY 1")
def first_accepted_wins(t: Tables) -> DataFrame:
    judged = t("judged").withColumn("evidence", F.lit(None).cast("string"))  # not looked at
    return R.concluded(t("candidates"), judged).where("leads").groupBy("task_id").agg(F.count_if("reused").alias("reused"), F.count("*").alias("groups"))


@query(
    _SETTLED
    + """, m AS (SELECT task_id, source_id AS anchor, max(type) FILTER (occurrence_id = source_id) AS type, max(explanation) FILTER (occurrence_id = source_id) AS explanation, max(i) FILTER (occurrence_id = source_id) AS ap, string_agg(evidence, '; ' ORDER BY i) AS evidence, string_agg(occurrence_id, ',' ORDER BY i) AS ids FROM projected GROUP BY 1, 2),
  n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ap) AS sequence FROM m WHERE ap IS NOT NULL) SELECT task_id, sequence, type, explanation, ids AS candidate_ids, sha256(sequence || chr(31) || type || chr(31) || explanation || chr(31) || evidence || chr(31) || ids) AS id FROM n"""
)
def merged_conclusions(t: Tables) -> DataFrame:
    return R.merged(_projected(t)).select("task_id", big(c("sequence")).alias("sequence"), "type", "explanation", F.array_join("candidate_ids", ",").alias("candidate_ids"), "id")


@query(
    _SETTLED
    + """, anchored AS (SELECT p.*, CASE WHEN o.part % 31 = 0 THEN 'C-none' WHEN o.part % 37 = 0 THEN 'C' || (o.l_orderkey) || '-' || (o.l_linenumber + 1) ELSE source_id END AS anchor FROM projected p JOIN candidates o USING (occurrence_id)),
  pairs AS (SELECT a.*, b.i AS ap, b.anchor AS aa, b.type AS t, b.explanation AS e FROM anchored a LEFT JOIN anchored b ON b.task_id = a.task_id AND b.occurrence_id = a.anchor),
  split AS (SELECT *, trim(unnest(CASE WHEN type = 'SPLIT' THEN string_split(explanation, '<br>') ELSE [explanation] END)) AS path, type = 'SPLIT' AND len(string_split(explanation, '<br>')) < 2 AS bad FROM anchored)
  SELECT 'known anchor' AS rule, task_id || '|' || occurrence_id AS key, anchor AS detail FROM pairs WHERE ap IS NULL UNION ALL SELECT 'earlier anchor', task_id || '|' || occurrence_id, anchor FROM pairs WHERE ap > i
  UNION ALL SELECT 'self-anchored', task_id || '|' || occurrence_id, anchor FROM pairs WHERE ap IS NOT NULL AND aa <> anchor UNION ALL SELECT 'one type and path', task_id || '|' || occurrence_id, anchor FROM pairs WHERE type <> t OR explanation <> e
  UNION ALL SELECT 'one disposition', task_id || '|' || lower(regexp_replace(path, '\\s+', ' ', 'g')), CAST(count(DISTINCT (type, anchor)) AS VARCHAR) FROM split WHERE NOT bad GROUP BY task_id, lower(regexp_replace(path, '\\s+', ' ', 'g')) HAVING count(DISTINCT (type, anchor)) > 1"""
)
def anchor_violations(t: Tables) -> DataFrame:
    other = F.when(c("part") % 31 == 0, "C-none").when(c("part") % 37 == 0, F.concat(F.lit("C"), "l_orderkey", F.lit("-"), c("l_linenumber") + 1))
    wrong = t("candidates").select("occurrence_id", other.alias("other")).where("other IS NOT NULL")
    # of the evidence the anchor alone is needed, and it alone is dealt out
    rows = _projected(t).select("task_id", "occurrence_id", "position_index", "type", "explanation", F.concat(F.lit("groupAnchorId="), R.anchor(c("evidence"))).alias("evidence"))
    rows = rows.join(wrong, "occurrence_id", "left").withColumn("evidence", F.when(c("other").isNotNull(), F.concat(F.lit("groupAnchorId="), "other")).otherwise(c("evidence")))
    return R.page_violations(rows)


@query(", v AS (SELECT id, conclusion_id, candidate_id FROM links JOIN conclusions ON id = conclusion_id) SELECT id, candidate_id FROM v JOIN candidates ON occurrence_id = candidate_id WHERE part % 3 = 0 OR l_linenumber = 2")
def inexact_references(t: Tables) -> DataFrame:
    swapped = F.when(c("part") % 3 == 0, F.concat(F.lit("unitId="), "unit_id", F.lit("; documentId="), "document_id")).when(c("l_linenumber") == 2, F.concat(F.lit("documentId="), "document_id", F.lit("; note; unitId="), "unit_id")).otherwise(c("evidence_text"))
    own = t("candidates").select(c("occurrence_id").alias("candidate_id"), swapped.alias("evidence"))
    rows = t("links").join(own, "candidate_id").select("task_id", c("conclusion_id").alias("id"), "evidence", F.array("candidate_id").alias("candidate_ids"))
    return R.exact_references(rows, t("candidates")).select("id", "candidate_id")


_MESSAGES = ["Each page target candidateId must have exactly one conclusion", "Business path must not be blank", "Every anchored group must close on a global candidate", "Expected strict final reconciliation Markdown with candidateIds= token in each row", "Expected strict final reconciliation Markdown with two tables", "Each normalized business path must retain one groupAnchorId and conclusion type", "something else"]
_CATEGORIES = ["MISSING_TARGET", "BUSINESS_PATH_STRUCTURE", "ANCHOR_CONFLICT", "MISSING_TARGET", "STRICT_MARKDOWN", "NORMALIZED_PATH_CONFLICT", "UNKNOWN_CONTRACT"]


@query(f"SELECT event_id, CASE event_id % 8 {' '.join(f'WHEN {k} THEN {chr(39)}{v}{chr(39)}' for k, v in enumerate(_CATEGORIES))} ELSE 'UNKNOWN_CONTRACT' END AS category, event_id % 8 IN (0, 1, 3) AS recheck FROM events", frames=False)
def failure_categories(t: Tables) -> DataFrame:
    message = F.get(F.array(*map(F.lit, _MESSAGES)), (c("event_id") % 8).cast("int"))  # null for 7
    category = R.failure_category(message)
    return t("events").select("event_id", category.alias("category"), R.may_recheck_alone(category).alias("recheck"))


@query("SELECT event_id, 'base|' || CASE WHEN event_type = 'click' THEN 'A' WHEN contains(event_type, 'e') THEN 'B' WHEN contains(event_type, 'r') THEN 'C' ELSE 'D' END AS feedback FROM events", frames=False)
def retry_feedback(t: Tables) -> DataFrame:
    return t("events").select("event_id", R.feedback(c("event_type"), {"click": "A"}, {"e": "B", "r": "C"}, "D", "base|").alias("feedback"))


# Scans, scopes and scalars


@query(", two AS (SELECT task_id, document_id, unit_id, 'Leaf ' || (supp % 4) AS f, flag AS g, 'e' || (part % 2) AS e, occurrence_id, l_linenumber FROM candidates JOIN lines USING (l_orderkey, l_linenumber, part, supp)) SELECT occurrence_id, NOT EXISTS (SELECT 1 FROM two a WHERE a.l_linenumber <= 3 AND a.unit_id = b.unit_id AND a.f = b.f AND a.g = b.g AND a.e = b.e) AS is_new FROM two b WHERE l_linenumber > 3")
def second_scan(t: Tables) -> DataFrame:
    rows = t("candidates").select("task_id", "document_id", "unit_id", F.concat(F.lit("Leaf "), c("supp") % 4).alias("feature_text"), "category", F.concat(F.lit("e"), c("part") % 2).alias("evidence_text"), "occurrence_id", "l_linenumber")
    return V.second_pass(rows.where("l_linenumber <= 3").drop("occurrence_id"), rows.where("l_linenumber > 3")).select("occurrence_id", "is_new")


@query("SELECT o_orderkey, o_custkey % 3 = 1 AND (o_custkey % 2 = 0 OR o_orderstatus = 'F') AND o_orderkey % 4 IN (1, 2) AS allowed FROM orders", frames=False)
def scope_membership(t: Tables) -> DataFrame:
    same = F.lit("x")
    scope = dict.fromkeys(S.COORDINATE, same) | {"system_id": F.lit(1).cast("bigint"), "project_id": F.when(c("o_custkey") % 2 == 1, "F"), "document_ids": F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))}
    evidence = dict.fromkeys(S.COORDINATE, same) | {"system_id": c("o_custkey") % 3, "project_id": c("o_orderstatus"), "document_id": c("o_orderkey") % 4}
    return t("orders").select("o_orderkey", S.allows(scope, evidence).alias("allowed"))


@query("SELECT o_orderkey, o_custkey % 10 IN (SELECT s_suppkey % 10 FROM supplier WHERE s_nationkey % 2 = 0 AND s_suppkey < 10) AS usable FROM orders", frames=False)
def usable_examples(t: Tables) -> DataFrame:
    documents = t("supplier").where("s_suppkey < 10").select(F.lit("kb").alias("knowledge_base_id"), c("s_suppkey").alias("id"), F.lit("completed").alias("parse_status"), F.when(c("s_nationkey") % 2 == 0, "enabled").otherwise("disabled").alias("enable_status"))
    chosen = t("orders").select("o_orderkey", F.lit("kb").alias("knowledge_base_id"), (c("o_custkey") % 10).alias("document_id"))
    return S.usable_examples(chosen, documents).select("o_orderkey", "usable")


@query("SELECT event_id, coalesce(nullif(trim(coalesce(event_type, '')), ''), 'none') AS name, CAST(NULL AS VARCHAR) AS number_is_none, CASE WHEN event_id % 3 = 0 THEN 'one' WHEN event_id % 3 = 1 THEN 'a,b' END AS kinds FROM events", frames=False)
def json_alternatives(t: Tables) -> DataFrame:
    named = F.to_json(F.struct(F.lit(" ").alias("call_id"), c("event_type").alias("id"), c("event_id").alias("n")))
    many = F.when(c("event_id") % 3 == 0, '{"kind": "one"}').when(c("event_id") % 3 == 1, '{"kinds": ["a", "b"]}').otherwise("{}")
    return t("events").select("event_id", X.first_text(named, "$.tool_call_id", "$.call_id", "$.id").alias("name"), X.first_text(named, "$.n").alias("number_is_none"), F.array_join(X.one_or_many(many, "kinds", "kind"), ",").alias("kinds"))


@query("""SELECT event_id, 'id=' || event_id || ' Token: <credential-redacted>, "password": "<credential-redacted>", <credential-redacted> end' AS shown FROM events""", frames=False)
def sanitized_diagnostics(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("id="), "event_id", F.lit(" Token: Bearer abc"), "event_id", F.lit(', "password": "x\\"y'), "user_id", F.lit('", sk-abcdefgh'), "user_id", F.lit(" end"))
    return t("events").select("event_id", X.sanitize(raw).alias("shown"))


@query(" SELECT occurrence_id, CASE WHEN part % 2 = 0 THEN 'line ' || l_linenumber ELSE '' END AS reader FROM candidates")
def reader_evidence(t: Tables) -> DataFrame:
    return t("candidates").select("occurrence_id", X.without_machine_tokens(c("evidence_text")).alias("reader"))


@query("SELECT event_id, greatest(1, CAST(floor(value * 1000) AS BIGINT) // 1000) AS lease, ts + to_microseconds(greatest(1, CAST(floor(value * 1000) AS BIGINT) // 1000)) AS until, ts + INTERVAL 5 MINUTE > TIMESTAMP '2024-01-10' AS fresh FROM events WHERE value IS NOT NULL", frames=False)
def lease_times(t: Tables) -> DataFrame:
    micros = T.lease_micros(F.floor(c("value") * 1000).cast("bigint"))
    return t("events").where("value IS NOT NULL").select("event_id", micros.alias("lease"), T.after_micros(c("ts"), micros).alias("until"), T.is_fresh(c("ts"), 300, F.lit("2024-01-10").cast("timestamp_ntz")).alias("fresh"))


@query("SELECT doc_id, left(text, 40) AS cut, CASE WHEN lang = 'en' THEN 7 END AS number, 'doc ' || doc_id || ' in ' || lang AS prompt, upper(lang) AS wire FROM documents WHERE text IS NOT NULL", frames=False)
def bounded_texts(t: Tables) -> DataFrame:
    number = X.positive_integer(F.when(c("lang") == "en", "007").when(c("lang") == "fr", "0").when(c("lang") == "de", "-7").otherwise("7x"))
    return t("documents").where("text IS NOT NULL").select("doc_id", X.left_utf16(c("text"), 40).alias("cut"), number.alias("number"), X.template("doc {id} in {lang}", id=c("doc_id"), lang=c("lang")).alias("prompt"), F.upper("lang").alias("wire"))


@query("SELECT page_id, length(url) AS n, CAST(greatest(1, ceil(page_id / 20)) AS BIGINT) AS pages FROM pages WHERE url LIKE 'https:%'", frames=False)
def optional_filters(t: Tables) -> DataFrame:
    rows = t("pages").where(K.if_set(c("page_id"), None) & K.if_set(F.substring_index("url", ":", 1), "https"))
    return rows.select("page_id", big(F.length("url")).alias("n"), K.page_count(c("page_id"), 20).alias("pages"))


@query(", ch AS (SELECT id, lag(status) OVER (PARTITION BY batch_id ORDER BY attempt_number) AS s, status AS t FROM attempts) SELECT id, s AS source, t AS target FROM ch WHERE s IS NOT NULL AND NOT (s = 'RUNNING' AND t IN ('ACCEPTED', 'FAILED', 'CANCELLED'))")
def illegal_batch_changes(t: Tables) -> DataFrame:
    changes = L.previous(t("attempts"), ["batch_id"], [c("attempt_number")], "status", "source").where("source IS NOT NULL").withColumnRenamed("status", "target")
    return L.illegal_transitions(changes, L.BATCH_TRANSITIONS).select("id", "source", "target")


@query(" SELECT id, 'k-' || substr(sha256(id || chr(10) || status), 1, 24) AS opaque FROM batches")
def opaque_batch_ids(t: Tables) -> DataFrame:
    return t("batches").select("id", I.opaque_id("k-", c("id"), c("status")).alias("opaque"))


# Constraints and writes


@query(""", b AS (SELECT 'B' || (o_orderkey // 2) AS id, task_id, feature_id, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE batch_sequence END AS batch_sequence, CASE WHEN o_orderkey % 70 > 0 THEN status END AS status, o_orderkey FROM batches JOIN units USING (task_id) WHERE feature_id = 'F' || o_orderkey), p AS (SELECT task_id FROM tasks WHERE created % 10 > 0)
  SELECT 'not null status' AS rule, id AS key, 'false' AS detail FROM b WHERE status IS NULL UNION ALL SELECT 'unique id', id, CAST(count(*) AS VARCHAR) FROM b GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'unique task_id, batch_sequence', task_id || '|' || batch_sequence, CAST(count(*) AS VARCHAR) FROM b GROUP BY task_id, batch_sequence HAVING count(*) > 1
  UNION ALL SELECT 'check batch_sequence > 0', id, 'false' FROM b WHERE NOT batch_sequence > 0 UNION ALL SELECT 'foreign task_id', task_id, 'no parent' FROM b WHERE task_id NOT IN (SELECT task_id FROM p)""")
def batch_constraints(t: Tables) -> DataFrame:
    from ledgerloom.plans import schemas

    k = F.substring("id", 2, 20).cast("bigint")
    rows = t("batches").withColumns({"id": F.concat(F.lit("B"), F.floor(k / 2)), "batch_sequence": F.when(k % 50 == 0, 0).otherwise(c("batch_sequence")), "status": F.when(k % 70 > 0, c("status"))})
    return schemas.violations("generation_batch", {"generation_batch": rows.select("id", "task_id", "feature_id", "batch_sequence", "status"), "generation_task": t("tasks").where("created % 10 > 0").select(c("task_id").alias("id"))})


@query(" SELECT id, CAST(attempt_number AS BIGINT) AS attempt_number, coalesce(CASE WHEN attempt_number > 3 THEN failure_reason END, 'none') AS failure_reason, CAST(attempt_number <= 3 AS VARCHAR) AS kept FROM attempts WHERE attempt_number < 6")
def overlaid_attempts(t: Tables) -> DataFrame:
    rows = t("attempts").where("attempt_number < 6").select("id", big(c("attempt_number")).alias("attempt_number"), "failure_reason")
    first, later = rows.where("attempt_number <= 3").withColumn("failure_reason", F.lit("none")), rows.where("attempt_number > 3")
    both = first.unionByName(later)  # pages accumulate
    return both.select("id", "attempt_number", F.coalesce("failure_reason", F.lit("none")).alias("failure_reason"), (c("attempt_number") <= 3).cast("string").alias("kept"))


@query(" SELECT task_id, string_agg(flag, ',' ORDER BY first) AS flags, count(*) AS kinds FROM (SELECT task_id, category AS flag, min(position) AS first FROM candidates GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(t: Tables) -> DataFrame:
    firsts = t("candidates").groupBy("task_id", "category").agg(F.min("position").alias("first"))  # first-seen order by partial aggregates
    out = firsts.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("first", "category"))).alias("m"))
    return out.select("task_id", F.array_join(F.transform("m", lambda x: x["category"]), ",").alias("flags"), F.size("m").cast("bigint").alias("kinds"))


@query(" SELECT task_id, artifact_id FROM tasks WHERE status IN ('COMPLETED', 'PARTIAL') AND artifact_id IS NOT NULL")
def ready_artifacts(t: Tables) -> DataFrame:
    return t("tasks").where(c("status").isin("COMPLETED", "PARTIAL") & c("artifact_id").isNotNull()).select("task_id", "artifact_id")


# Scopes and acceptance

_SCOPE = {
    "bases": "SELECT 'kb' || r_regionkey AS id, r_name AS name, CASE WHEN r_regionkey = 4 THEN 'faq' ELSE 'document' END AS type FROM {region}",
    "containers": "SELECT 'kb' || n_regionkey AS knowledge_base_id, CASE WHEN n_nationkey % 6 = 5 THEN 'folder' ELSE 'system' END AS container_type, 's' || n_nationkey AS system_id, CASE WHEN n_nationkey % 4 = 0 THEN ' ' ELSE n_name END AS system_name FROM {nation}",
    "versions": "SELECT 'v' || n_nationkey || '-' || k AS id, 's' || n_nationkey AS system_id, CASE WHEN k = 2 AND n_nationkey % 3 = 0 THEN 'retired' ELSE 'active' END AS status, 'V' || k AS display_name FROM {nation} CROSS JOIN (VALUES (1), (2)) AS v(k)",
    "material": """SELECT 'd' || s_suppkey AS id, 'kb' || n_regionkey AS knowledge_base_id, 'h' || (s_suppkey % 40) AS file_hash, CASE WHEN s_suppkey % 7 = 0 THEN 'failed' ELSE 'completed' END AS parse_status, CASE WHEN s_suppkey % 9 = 0 THEN 'disabled' ELSE 'enabled' END AS enable_status,
        CASE WHEN s_suppkey % 13 = 0 THEN 'other' ELSE 'admission_material' END AS content_category, CASE WHEN s_suppkey % 11 > 0 THEN 'p' || (s_suppkey % 2) END AS project_id, CASE s_suppkey % 3 WHEN 0 THEN 'function_list' WHEN 1 THEN 'work_order_plan' ELSE 'requirements_spec' END AS content_type_key,
        CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE 'Kind ' || (s_suppkey % 3) END AS content_type_name, 's' || s_nationkey AS system_id, 'v' || s_nationkey || '-' || (1 + s_suppkey % 2) AS version_id FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey""",
}
FRAMES |= _SCOPE
_SELECTED = (
    "WITH "
    + ", ".join(f"{name} AS ({sql.format_map(DRIVER)})" for name, sql in _SCOPE.items())
    + """, docs AS (SELECT m.*, coalesce(nullif(trim(content_type_name), ''), content_type_key) AS label FROM material m WHERE parse_status = 'completed' AND enable_status = 'enabled' AND content_category = 'admission_material' AND project_id IS NOT NULL),
  chosen AS (SELECT d.knowledge_base_id AS kb, b.name AS kb_name, d.system_id, system_name, version_id, display_name, project_id, content_type_key, label, string_agg(DISTINCT d.id, ',' ORDER BY d.id) AS ids, count(DISTINCT d.id) AS n, list(d.file_hash) AS hashes
    FROM docs d JOIN containers c ON c.knowledge_base_id = d.knowledge_base_id AND c.system_id = d.system_id AND container_type = 'system' JOIN versions v ON v.id = version_id AND v.system_id = d.system_id AND v.status = 'active' JOIN bases b ON b.id = d.knowledge_base_id AND b.type = 'document'
    GROUP BY ALL),
  ids AS (SELECT *, 'scope-' || substr(sha256(kb || chr(10) || system_id || chr(10) || version_id || chr(10) || project_id || chr(10) || 'admission_material' || chr(10) || content_type_key || chr(10) || ids), 1, 24) AS selection_id FROM chosen)"""
)


def _selections(t: Tables) -> DataFrame:
    scope = F.struct("content_category", "project_id", "content_type_key", "content_type_name", "system_id", "version_id")
    return S.selections(t("bases"), t("containers"), t("versions"), t("material").select("id", "knowledge_base_id", "file_hash", "parse_status", "enable_status", scope.alias("knowledge_scope")))


@query(_SELECTED + " SELECT selection_id, kb AS knowledge_base_id, version_id, project_id, label AS type_label, ids AS document_ids, n AS n_documents FROM ids", frames=False)
def scope_selections(t: Tables) -> DataFrame:
    return _selections(t).select("selection_id", "knowledge_base_id", "version_id", "project_id", "type_label", F.array_join("document_ids", ",").alias("document_ids"), big(c("n_documents")).alias("n_documents"))


@query(
    _SELECTED
    + """, s AS (SELECT kb_name, coalesce(nullif(trim(system_name), ''), kb_name) AS name, 'system-' || substr(sha256(kb || chr(10) || system_id), 1, 24) AS key, display_name, version_id, string_agg(label || ' ' || n, ' ' ORDER BY label, content_type_key, selection_id) AS kinds FROM ids GROUP BY ALL),
  v AS (SELECT kb_name, name, key, string_agg(display_name || ': ' || kinds, '; ' ORDER BY display_name, version_id) AS versions FROM s GROUP BY ALL) SELECT kb_name AS knowledge_base_name, string_agg(name || ' (' || versions || ')', ', ' ORDER BY name, key) AS tree FROM v GROUP BY 1""",
    frames=False,
)
def scope_tree(t: Tables) -> DataFrame:
    kind = lambda k: F.concat_ws(" ", k["label"], k["n_documents"].cast("string"))
    version = lambda v: F.concat(v["name"], F.lit(": "), F.array_join(F.transform(v["material_types"], kind), " "))
    system = lambda s: F.concat(s["name"], F.lit(" ("), F.array_join(F.transform(s["versions"], version), "; "), F.lit(")"))
    return S.catalog_tree(_selections(t)).select("knowledge_base_name", F.array_join(F.transform("systems", system), ", ").alias("tree"))


@query(
    _SELECTED
    + """, k AS (SELECT kb, count(DISTINCT (kb, system_id, version_id, project_id)) AS n, bool_or(content_type_key = 'function_list') AS l, bool_or(content_type_key <> 'function_list') AS f FROM ids GROUP BY 1)
  SELECT 'one coordinate' AS rule, kb AS key, CAST(n AS VARCHAR) AS detail FROM k WHERE n > 1 UNION ALL SELECT 'function list', kb, 'missing' FROM k WHERE NOT l UNION ALL SELECT 'formal requirement', kb, 'missing' FROM k WHERE NOT f
  UNION ALL SELECT 'distinct hashes', kb, h FROM (SELECT kb, unnest(hashes) AS h FROM ids) GROUP BY kb, h HAVING count(*) > 1""",
    frames=False,
)
def selection_violations(t: Tables) -> DataFrame:
    return S.selection_violations(_selections(t).withColumn("task_id", c("knowledge_base_id")))


_CASES = """, tg AS (SELECT 'B' || l_orderkey AS batch_id, l_orderkey AS o, 'Area ' || l_orderkey || '/Leaf ' || l_orderkey AS path, 'Leaf ' || l_orderkey AS leaf, l_orderkey % 8 <> 7 AS eligible, list(occurrence_id) AS ids FROM candidates GROUP BY l_orderkey),
  cs AS (SELECT 'B' || l_orderkey AS batch_id, CASE WHEN part % 9 = 0 THEN 'x' WHEN l_linenumber = 1 THEN 'Leaf ' || l_orderkey || '_正向' ELSE 'Leaf ' || l_orderkey || '_反向' END AS name, part, supp, occurrence_id FROM candidates WHERE l_linenumber <= 2)"""


@query(
    _CASES
    + """, per AS (SELECT batch_id, count(*) AS n, list_sort(list(DISTINCT name)) AS names FROM cs GROUP BY 1)
  SELECT 'eligible' AS rule, batch_id AS key, 'the target generates nothing' AS detail FROM tg WHERE NOT eligible UNION ALL SELECT 'two cases', batch_id, CAST(coalesce(n, 0) AS VARCHAR) FROM tg LEFT JOIN per USING (batch_id) WHERE coalesce(n, 0) <> 2
  UNION ALL SELECT 'names', batch_id, array_to_string(names, ',') FROM tg JOIN per USING (batch_id) WHERE names <> list_sort([leaf || '_正向', leaf || '_反向']) UNION ALL SELECT 'module', batch_id, 'Other' FROM cs WHERE part % 11 = 0
  UNION ALL SELECT 'numbering', batch_id, name FROM cs WHERE part % 13 = 0 OR supp % 7 = 0 UNION ALL SELECT 'requirement', batch_id, CASE part % 5 WHEN 1 THEN 'read; candidateIds=C-x' ELSE 'read only' END FROM cs WHERE part % 5 IN (1, 2)
  UNION ALL SELECT 'subject', batch_id, 'Else' FROM cs WHERE part % 6 = 0 UNION ALL SELECT 'evidence', batch_id, 'none' FROM cs WHERE part % 10 = 0"""
)
def refused_batches(t: Tables) -> DataFrame:
    path = F.concat(F.lit("Area "), "l_orderkey", F.lit("/Leaf "), "l_orderkey")
    batch = F.concat(F.lit("B"), "l_orderkey").alias("batch_id")
    part = c("part")
    targets = t("candidates").groupBy("l_orderkey").agg(F.collect_list("occurrence_id").alias("candidate_ids")).select(batch, path.alias("feature_name"), (c("l_orderkey") % 8 != 7).alias("generation_eligible"), "candidate_ids")
    rows = t("candidates").where("l_linenumber <= 2")
    own = F.concat(F.lit("read; candidateIds="), "occurrence_id")
    cases = rows.select(
        batch,
        F.when(part % 9 == 0, "x").otherwise(F.concat(F.lit("Leaf "), "l_orderkey", F.when(c("l_linenumber") == 1, "_正向").otherwise("_反向"))).alias("case_name"),
        F.when(part % 11 == 0, "Other").otherwise(path).alias("feature_module"),
        F.when(part % 13 == 0, "1. a\n3. b").otherwise("1. a\n2. b").alias("execution_steps"),
        F.when(c("supp") % 7 == 0, "1. c").otherwise(F.when(part % 13 == 0, "1. c\n3. d").otherwise("1. c\n2. d")).alias("expected_result"),
        F.when(part % 5 == 0, V.GENERAL).when(part % 5 == 1, "read; candidateIds=C-x").when(part % 5 == 2, "read only").otherwise(own).alias("requirement_content"),
    )
    audit = rows.select(batch, F.when(part % 6 == 0, "Else").otherwise(path).alias("subject"), F.when(part % 10 == 0, "none").otherwise(F.concat(F.lit("candidateIds="), "occurrence_id")).alias("evidence"))
    return V.refused_batches(targets, audit, cases)


@query(""", r AS (SELECT 'N' || o_orderkey AS requested_id, CASE WHEN o_orderkey % 6 > 0 THEN 'key' || (o_custkey % 50) END AS idempotency_key FROM units), s AS (SELECT 'key' || created AS idempotency_key, task_id FROM tasks WHERE created < 20)
  SELECT r.idempotency_key, requested_id, coalesce(s.task_id, CASE WHEN r.idempotency_key IS NOT NULL THEN min(requested_id) OVER (PARTITION BY r.idempotency_key) END, requested_id) AS task_id,
  s.task_id IS NULL AND (r.idempotency_key IS NULL OR requested_id = min(requested_id) OVER (PARTITION BY r.idempotency_key)) AS is_new FROM r LEFT JOIN s USING (idempotency_key)""")
def idempotent_creation(t: Tables) -> DataFrame:
    stored = t("tasks").where("created < 20").select("task_id", F.concat(F.lit("key"), "created").alias("idempotency_key"))
    requests = t("units").select(F.concat(F.lit("N"), "o_orderkey").alias("task_id"), F.when(c("o_orderkey") % 6 > 0, F.concat(F.lit("key"), c("o_custkey") % 50)).alias("idempotency_key"))
    return K.created_once(stored, requests)
