"""Queries of flows and contracts against their SQL, over the small tables."""

import pytest

from ledgerloom import contract_queries, flow_queries
from tests.oracle import same

SF = "/root/testdata/sf0.001"
ORACLES = {**flow_queries.ORACLES, **contract_queries.ORACLES}
QUERIES = {**flow_queries.QUERIES, **contract_queries.QUERIES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same(spark, QUERIES[name], ORACLES[name], SF)


def test_lease_changes(spark):
    """Each claim is closed by at most one change of its slot, and no slot holds two tasks."""
    rows = QUERIES["lease_changes"](spark, SF).where("slot IS NOT NULL").collect()
    held = {}
    for r in sorted(rows, key=lambda r: (r.at, r.change == "claimed")):
        key = r.pool, r.slot
        if r.change == "claimed":
            assert key not in held
            held[key] = r.task_id, r.attempt
        else:
            assert held.pop(key) == (r.task_id, r.attempt)
    assert rows and not held and {r.change for r in rows} >= {"claimed", "requeued", "failed", "completed"}


def test_outcomes_take_several_values(spark):
    several = {"answer_calls": "status", "replayed_rows": "outcome", "scanned_rounds": "passes", "bound_coordinates": "bound", "material_roles": "role", "selection_rules": "rule", "paged_units": "rule", "material_review_rules": "rule", "testcase_rules": "rule", "registry_rules": "rule"}
    for name, column in several.items():
        assert QUERIES[name](spark, SF).select(column).distinct().count() > 1, name


def test_scanned_lines_are_made_once(spark, monkeypatch):
    """Each pass reads the found lines from a table; none makes them of the line items again."""
    from ledgerloom import flow_queries

    names = []
    plain = flow_queries.written
    monkeypatch.setattr(flow_queries, "written", lambda df, name: names.append(name) or plain(df, name))
    flow_queries.QUERIES["scanned_rounds"](spark, "/root/testdata/sf0.001")
    assert names == ["found"]
