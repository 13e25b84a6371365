"""Every query over ledger-shaped tables against its SQL, over the small tables."""

import pytest

from ledgerloom.ledger_queries import ORACLES, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001")


def test_each_query_meets_rows_of_both_kinds(spark):
    """Outcomes, flags and rules take several values each, so that the comparison with SQL can fail."""
    several = {"audit_gate": "reason", "finalization": "terminal", "exactly_once_acceptance": "outcome", "inventory_replay": "outcome", "anchor_violations": "rule", "freeze_violations": "rule", "requeued_tasks": "new_status", "second_scan": "is_new", "viewer_flags": "active_stage", "first_accepted_wins": "reused", "scope_membership": "allowed", "failure_categories": "category"}
    for name, column in several.items():
        assert QUERIES[name](spark, "/root/testdata/sf0.001").select(column).distinct().count() > 1, name


def test_the_gate_deals_no_target_out_once_a_column(spark, capsys):
    """Distinct counts of several columns at once would send each target, with its digest, once for each of them."""
    for name in ("audit_gate", "finalization"):
        QUERIES[name](spark, "/root/testdata/sf0.001").explain()
        assert "Expand" not in capsys.readouterr().out, name


def test_gate_reasons_of_odd_rows(spark):
    """A conclusion given twice, a candidate without an id, and a target of a candidate that is not there."""
    from ledgerloom.plans.tasks import audit_gate

    names = ["ok", "twice", "null", "foreign", "renumbered"]
    tasks = spark.createDataFrame([(n, 1) for n in names], "task_id string, material_documents long")
    documents = spark.createDataFrame([(n, True) for n in names], "task_id string, complete boolean")
    work = spark.createDataFrame([(n, "COMPLETED") for n in names], "task_id string, status string")
    candidates = spark.createDataFrame([(n, None if n == "null" else "c") for n in names], "task_id string, occurrence_id string")
    conclusions = spark.createDataFrame([(n, "k", "MATCHED", "p") for n in [*names, "twice"]], "task_id string, id string, conclusion_type string, explanation string")
    links = spark.createDataFrame([(n, "k", "c") for n in names], "task_id string, conclusion_id string, candidate_id string")
    own = lambda n: ["c", "d"] if n == "foreign" else ["c"]
    frozen = spark.createDataFrame([(n, "f", 2 if n == "renumbered" else 1, True, "k", "MATCHED", "p", own(n)) for n in names], "task_id string, stable_feature_id string, stable_sequence int, generation_eligible boolean, conclusion_id string, conclusion_type string, decision_reason string, candidate_ids array<string>")
    links = links.unionByName(spark.createDataFrame([("foreign", "k", "d")], links.schema))
    candidates = candidates.unionByName(spark.createDataFrame([("foreign", "c")], candidates.schema))
    got = {r.task_id: r.reason for r in audit_gate(tasks, documents, work, candidates, conclusions, links, frozen).collect()}
    assert got == {"ok": None, "twice": "conclusions", "null": "targets against candidates", "foreign": "targets against candidates", "renumbered": "target numbering"}
