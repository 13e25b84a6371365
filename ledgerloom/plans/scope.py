"""The scope catalog, what a selection must meet, and the work that a read inventory opens."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions.ids import name_uuid, opaque_id

# Categories, kinds of material and their roles, and the stages and passes of each role.
ADMISSION = "admission_material"
ROLES = {"function_list": "FUNCTION_LIST", "work_order_plan": "WORK_ORDER_PLAN", "requirements_spec": "REQUIREMENT"}
FORMAL = ["requirements_spec", "work_order_plan"]
COORDINATE = ["knowledge_base_id", "system_id", "version_id", "project_id", "material_category"]


def eligible_documents(containers: DataFrame, versions: DataFrame, documents: DataFrame, admission: str = ADMISSION) -> DataFrame:
    """Documents that a task may read, with system and version: three equi-joins in place of nested loops."""
    s = "knowledge_scope."
    docs = documents.where((F.col("parse_status") == "completed") & (F.col("enable_status") == "enabled") & (F.col(s + "content_category") == admission))
    for c in (s + "project_id", "file_hash", s + "content_type_key"):
        docs = docs.where(~X.is_blank(F.col(c)))
    docs = docs.select(
        F.col("id").alias("document_id"), "knowledge_base_id", "file_hash", F.col(s + "system_id").alias("system_id"), F.col(s + "version_id").alias("version_id"),
        F.col(s + "project_id").alias("project_id"), F.col(s + "content_type_key").alias("type_key"), X.default_if_blank(F.col(s + "content_type_name"), F.col(s + "content_type_key")).alias("type_label"),
    )
    systems = containers.where((F.col("container_type") == "system") & ~X.is_blank(F.col("system_id"))).select("knowledge_base_id", "system_id", "system_name")
    active = versions.where("status = 'active'").select(F.col("id").alias("version_id"), "system_id", F.col("display_name").alias("version_name"))
    return docs.join(systems, ["knowledge_base_id", "system_id"]).join(active, ["version_id", "system_id"])


def selections(knowledge_bases: DataFrame, containers: DataFrame, versions: DataFrame, documents: DataFrame, admission: str = ADMISSION) -> DataFrame:
    """A row for each kind of material of each version and project that has documents; ids are opaque digests."""
    bases = knowledge_bases.where("type = 'document'").select(F.col("id").alias("knowledge_base_id"), F.col("name").alias("knowledge_base_name"))
    rows = eligible_documents(containers, versions, documents, admission).join(bases, "knowledge_base_id")
    keys = ["knowledge_base_id", "knowledge_base_name", "system_id", "system_name", "version_id", "version_name", "project_id", "type_key", "type_label"]
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("document_id")).alias("document_ids"), F.array_sort(F.collect_set(F.struct("document_id", "file_hash"))).alias("hashes"))
    c = F.col
    parts = [c("knowledge_base_id"), c("system_id"), c("version_id"), c("project_id"), F.lit(admission), c("type_key"), F.array_join("document_ids", ",")]
    return out.select(
        opaque_id("scope-", *parts).alias("selection_id"), *keys, "document_ids", "hashes", F.size("document_ids").alias("n_documents"), F.lit(admission).alias("material_category"),
        opaque_id("kb-", c("knowledge_base_id")).alias("kb_key"), opaque_id("system-", c("knowledge_base_id"), c("system_id")).alias("system_key"),
        opaque_id("version-", c("knowledge_base_id"), c("system_id"), c("version_id")).alias("version_key"),
    )


def catalog_tree(selected: DataFrame) -> DataFrame:
    """A row for each knowledge base: systems, their versions, and the kinds of material of each, all in order."""
    kind = F.struct(F.col("type_label").alias("label"), F.col("type_key").alias("key"), "selection_id", "n_documents")
    versions = selected.groupBy("kb_key", "knowledge_base_name", "system_key", "system_name", "version_key", "version_name", "version_id").agg(F.array_sort(F.collect_list(kind)).alias("material_types"))
    version = F.struct(F.col("version_name").alias("name"), "version_id", "version_key", "material_types")
    name = X.default_if_blank(F.col("system_name"), F.col("knowledge_base_name"))
    systems = versions.groupBy("kb_key", "knowledge_base_name", "system_key", name.alias("name")).agg(F.array_sort(F.collect_list(version)).alias("versions"))
    return systems.groupBy("kb_key", "knowledge_base_name").agg(F.array_sort(F.collect_list(F.struct("name", "system_key", "versions"))).alias("systems"))


def selection_violations(chosen: DataFrame) -> DataFrame:
    """(rule, key, detail) for the selections of tasks (task_id and columns of ``selections``)."""
    row = lambda df, rule, detail: df.select(F.lit(rule).alias("rule"), F.col("task_id").cast("string").alias("key"), detail.cast("string").alias("detail"))
    kinds = chosen.groupBy("task_id").agg(F.countDistinct(F.struct(*COORDINATE)).alias("n"), F.bool_or(F.col("type_key") == "function_list").alias("list"), F.bool_or(F.col("type_key").isin(FORMAL)).alias("formal"))
    each = chosen.select("task_id", "document_ids", F.explode("hashes").alias("h"))
    repeated = each.groupBy("task_id", F.col("h.file_hash").alias("hash")).agg(F.count("*").alias("n")).where(F.col("n").__gt__(1) | X.is_blank(F.col("hash")))
    other = chosen.where(F.array_sort(F.transform("hashes", lambda h: h["document_id"])) != F.array_sort("document_ids"))
    failed = [("one coordinate", F.col("n") > 1, F.col("n").cast("string")), ("function list", ~F.col("list"), F.lit("missing")), ("formal requirement", ~F.col("formal"), F.lit("missing"))]
    each_rule = F.array_compact(F.array(*(F.when(wrong, F.struct(F.lit(rule).alias("rule"), F.col("task_id").cast("string").alias("key"), detail.alias("detail"))) for rule, wrong, detail in failed)))
    return kinds.select(F.explode(each_rule).alias("r")).select("r.*").unionByName(row(repeated, "distinct hashes", F.col("hash"))).unionByName(row(other, "hashes of documents", F.col("type_key")))


def role(material_type: Column, admission_types: Column) -> Column:
    """A document's role; an old snapshot without a type has it from the task's only one. Otherwise an error."""
    kind = F.coalesce(material_type, F.when(F.size(admission_types) == 1, F.get(admission_types, F.lit(0))))
    out = F.raise_error(F.concat(F.lit("no role for material type "), F.coalesce(kind, F.lit("null")))).cast("string")
    for k, v in ROLES.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def open_work(units: DataFrame) -> DataFrame:
    """A row of audit work for each pass over each unit (task_id, document_id, unit_id, role): lists one, others two."""
    is_list = F.col("role") == "FUNCTION_LIST"
    stage = F.when(is_list, "FEATURE_LIST_SCAN").otherwise("REQUIREMENT_SCAN")
    rows = units.select("task_id", "document_id", "unit_id", stage.alias("audit_stage"), F.explode(F.sequence(F.lit(1), F.when(is_list, 1).otherwise(2))).alias("audit_pass"))
    name = F.concat_ws(":", "task_id", "document_id", "unit_id", F.col("audit_pass").cast("string"), "audit_stage")
    return rows.select(name_uuid(name).alias("id"), "*", F.lit("QUEUED").alias("status"))


def dispatch_violations(work: DataFrame, keys: list[str]) -> DataFrame:
    """(rule, key, detail) for work (``keys``, audit_stage, audit_pass, role) that no scanner takes: a list is scanned once
    as such, other material in two passes. Unknown stages and nulls are refused."""
    stage, number, kind = F.col("audit_stage"), F.col("audit_pass"), F.col("role")
    taken = (stage == "FEATURE_LIST_SCAN") & (number == 1) & (kind == "FUNCTION_LIST") | (stage == "REQUIREMENT_SCAN") & number.isin(1, 2) & kind.isin("REQUIREMENT", "WORK_ORDER_PLAN")
    shown = lambda names: F.concat_ws("|", *(F.coalesce(F.col(n).cast("string"), F.lit("null")) for n in names))
    return work.where(~F.coalesce(taken, F.lit(False))).select(F.lit("dispatch").alias("rule"), shown(keys).alias("key"), shown(["audit_stage", "audit_pass", "role"]).alias("detail"))


def allows(scope: dict[str, Column], evidence: dict[str, Column]) -> Column:
    """Whether evidence lies in a scope: equal base, system, version and category, the scope's project or any if it has
    none, and one of the scope's documents. Keys: the names of COORDINATE, document_ids (scope), document_id (evidence)."""
    same = F.lit(True)
    for name in COORDINATE:
        equal = scope[name] == evidence[name]
        same &= (scope[name].isNull() | equal) if name == "project_id" else equal
    return F.coalesce(same & F.array_contains(scope["document_ids"], evidence["document_id"]), F.lit(False))


def usable_examples(chosen: DataFrame, documents: DataFrame) -> DataFrame:
    """``chosen`` (knowledge_base_id, document_id) with usable: whether the document exists there, parsed and enabled."""
    good = (F.col("parse_status") == "completed") & (F.col("enable_status") == "enabled")
    known = documents.where(good).select("knowledge_base_id", F.col("id").alias("document_id"), F.lit(True).alias("usable")).distinct()
    return chosen.join(known, ["knowledge_base_id", "document_id"], "left").withColumn("usable", F.coalesce("usable", F.lit(False)))


class Snapshot:
    """A frame that is loaded at most once in ``ttl_seconds``, or when a refresh is asked for. It is computed before it
    takes the place of the one before, which stays if that fails; callers meanwhile wait for one load, not several."""

    def __init__(self, load: Callable[[], DataFrame], ttl_seconds: float, clock: Callable[[], float] = time.monotonic):
        self._load, self._ttl, self._clock = load, ttl_seconds, clock
        self._lock, self._held, self._loaded_at = threading.Lock(), None, 0.0

    def _fresh(self, since: float | None) -> bool:
        return self._held is not None and (self._loaded_at + self._ttl > self._clock() if since is None else self._loaded_at > since)

    def get(self, refresh: bool = False) -> DataFrame:
        asked = self._clock() if refresh else None
        if not self._fresh(asked):
            with self._lock:
                if not self._fresh(asked):
                    new = self._load().cache()
                    new.count()
                    old, self._held, self._loaded_at = self._held, new, self._clock()
                    if old is not None:
                        old.unpersist()
        return self._held
