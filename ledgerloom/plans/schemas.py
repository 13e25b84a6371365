"""Types and constraints of the ledger's tables, as they stand after the last change of their schema.

Time stamps have no zone, unsigned numbers are long, JSON stays text; ``!`` marks a column that is never null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.ledger import check_foreign, check_rows, check_unique


@dataclass(frozen=True)
class Table:
    """Columns, the unique keys (the primary one first), conditions on rows, and foreign keys (columns, parent, its columns)."""

    columns: str
    unique: list[list[str]]
    checks: list[str] = field(default_factory=list)
    foreign: list[tuple[list[str], str, list[str]]] = field(default_factory=list)

    @property
    def schema(self) -> T.StructType:
        parts = (c.split() for c in self.columns.split(","))
        return T.StructType([T.StructField(n, T.DataType.fromDDL(kind.rstrip("!")), not kind.endswith("!")) for n, kind in parts])


_MADE = "created_at timestamp_ntz!"
_KEPT = f"{_MADE}, updated_at timestamp_ntz!"
_UNIT = ["task_id", "document_id", "unit_id"]
_UNIT_OF = [(_UNIT, "material_inventory_unit", _UNIT)]
_TASK_OF = [(["task_id"], "generation_task", ["id"])]
_BATCH_OF = [(["batch_id"], "generation_batch", ["id"])]
_WORK_OF = [(["work_id"], "material_audit_work", ["id"])]

# Names, types and constraints of the tables.
TABLES = {
    "generation_task": Table(
        f"id string!, task_mode string!, status string!, idempotency_key string, request_snapshot string!, result_snapshot string, artifact_id string, artifact_sha256 string, artifact_path string, cancellation_requested_at timestamp_ntz, {_KEPT}",
        [["id"], ["idempotency_key"]], ["task_mode IN ('FEATURE', 'ALL')"],
    ),
    "generation_batch": Table(
        f"id string!, task_id string!, feature_id string!, batch_sequence bigint!, status string!, lease_owner string, lease_expires_at timestamp_ntz, accepted_result string, raw_completed_markdown string, {_KEPT}",
        [["id"], ["task_id", "feature_id"], ["task_id", "batch_sequence"]], ["batch_sequence > 0"], _TASK_OF,
    ),
    "generation_attempt": Table(
        f"id string!, batch_id string!, attempt_number bigint!, status string!, failure_reason string, retryable boolean!, {_MADE}, completed_at timestamp_ntz",
        [["id"], ["batch_id", "attempt_number"]], [], _BATCH_OF,
    ),
    "task_execution_slot": Table("slot_number smallint!, task_id string", [["slot_number"], ["task_id"]], ["slot_number BETWEEN 1 AND 5"], _TASK_OF),
    "generation_audit_row": Table("batch_id string!, row_sequence bigint!, subject_or_feature string!, issue_category string!, evidence_comparison string!", [["batch_id", "row_sequence"]], ["row_sequence > 0"], _BATCH_OF),
    "generation_test_case_row": Table(
        "batch_id string!, row_sequence bigint!, case_name string!, feature_module string!, preconditions string!, execution_steps string!, expected_result string!, requirement_content string!",
        [["batch_id", "row_sequence"]], ["row_sequence > 0"], _BATCH_OF,
    ),
    "material_inventory_document": Table(f"task_id string!, document_id string!, knowledge_id string!, document_role string!, total_units bigint!, complete boolean!, {_KEPT}", [["task_id", "document_id"]], ["complete"], _TASK_OF),
    "material_inventory_unit": Table(
        f"task_id string!, document_id string!, unit_id string!, document_role string!, chunk_index bigint!, ordinal bigint!, content string!, start_at bigint!, end_at bigint!, processing_status string!, {_KEPT}",
        [_UNIT], ["ordinal > 0", "end_at >= start_at"], [(_UNIT[:2], "material_inventory_document", _UNIT[:2])],
    ),
    "material_audit_work": Table(
        f"id string!, task_id string!, document_id string!, unit_id string!, audit_pass bigint!, audit_stage string!, status string!, lease_owner string, lease_expires_at timestamp_ntz, {_KEPT}",
        [["id"], [*_UNIT, "audit_pass", "audit_stage"]], ["audit_pass > 0", "status IN ('QUEUED', 'RUNNING', 'COMPLETED', 'FAILED')"], _UNIT_OF,
    ),
    "material_audit_attempt": Table(f"id string!, work_id string!, attempt_number bigint!, status string!, failure_summary string, {_MADE}, completed_at timestamp_ntz", [["id"], ["work_id", "attempt_number"]], ["status IN ('RUNNING', 'COMPLETED', 'FAILED')"], _WORK_OF),
    "feature_source_candidate": Table(
        f"id string!, task_id string!, document_id string!, unit_id string!, source_ordinal bigint!, model_sequence bigint!, candidate_kind string!, candidate_text string!, candidate_category string!, evidence_text string!, audit_pass bigint!, source_row_position bigint!, {_MADE}",
        [["task_id", "id"], [*_UNIT, "audit_pass", "source_row_position"]], ["source_ordinal > 0 AND model_sequence > 0 AND audit_pass > 0 AND source_row_position > 0"], _UNIT_OF,
    ),
    "feature_review_conclusion": Table(f"id string!, task_id string!, conclusion_sequence bigint!, conclusion_type string!, explanation string!, evidence_text string!, {_MADE}", [["task_id", "id"], ["task_id", "conclusion_sequence"]], ["conclusion_sequence > 0"], _TASK_OF),
    "feature_review_conclusion_candidate": Table(
        "task_id string!, conclusion_id string!, source_candidate_id string!", [["task_id", "conclusion_id", "source_candidate_id"], ["task_id", "source_candidate_id"]], [],
        [(["task_id", "conclusion_id"], "feature_review_conclusion", ["task_id", "id"]), (["task_id", "source_candidate_id"], "feature_source_candidate", ["task_id", "id"])],
    ),
    "material_audit_scan_outcome": Table(f"work_id string!, accepted_candidate_count bigint!, duplicate_occurrence_count bigint!, converged boolean!, {_MADE}", [["work_id"]], [], _WORK_OF),
    "material_audit_duplicate_occurrence": Table("work_id string!, occurrence_id string!, model_sequence bigint!, source_row_position bigint!, candidate_text string!, candidate_category string!, evidence_text string!", [["work_id", "occurrence_id"]], ["model_sequence > 0 AND source_row_position > 0"], _WORK_OF),
    "frozen_feature_target": Table(f"id string!, task_id string!, stable_feature_id string!, stable_sequence bigint!, feature_name string!, generation_eligible boolean!, source_summary string!, {_MADE}", [["id"], ["task_id", "stable_feature_id"], ["task_id", "stable_sequence"]], ["stable_sequence > 0"], _TASK_OF),
}


def typed(df: DataFrame, table: str) -> DataFrame:
    """The table's columns, in order and cast to its types; a missing column is an error, others are left out."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].schema))


def violations(table: str, tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, key, detail) for all constraints of a table over the frames given, of which the parents must be there. Keys
    with a null part are no duplicates, as in SQL. Columns that the frame lacks are not looked at."""
    spec, df = TABLES[table], tables[table]
    key = [k for k in spec.unique[0] if k in df.columns]
    have = lambda columns: all(x in df.columns for x in columns)
    parts = [check_rows(df, key, F.col(f.name).isNotNull(), f"not null {f.name}") for f in spec.schema if not f.nullable and f.name in df.columns]
    parts += [check_unique(df.dropna(subset=u), u, f"unique {', '.join(u)}") for u in spec.unique if have(u)]
    parts += [check_rows(df, key, F.expr(x), f"check {x}") for x in spec.checks]
    for columns, parent, keys in spec.foreign:
        if parent in tables and have(columns):
            known = tables[parent].select(*(F.col(k).alias(x) for k, x in zip(keys, columns, strict=True)))
            parts.append(check_foreign(df, known, columns, f"foreign {', '.join(columns)}"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
