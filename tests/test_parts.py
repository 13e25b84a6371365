"""Frames that have a row for each line item are dealt out into parts of a bounded number of rows."""

import re

import pytest

from ledgerloom.contract_queries import ORACLES, QUERIES
from ledgerloom.operators import tables
from tests.oracle import same

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "key"), [("continuous_ordinals", "l_orderkey"), ("paged_units", "document_id"), ("replayed_batch_plans", "task_id"), ("selection_rules", "l_orderkey")])
def test_parts_follow_the_rows(spark, monkeypatch, capsys, name, key):
    monkeypatch.setattr(tables, "PART_ROWS", 1000)
    parts = spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 1000 + 1
    QUERIES[name](spark, SMALL).explain()
    assert re.search(rf"hashpartitioning\({key}#\d+L?, {parts}\), REPARTITION_BY_NUM", capsys.readouterr().out)
    same(spark, QUERIES[name], ORACLES[name], SMALL)


def test_selection_rules_read_each_task_once_for_all_rules_of_it(spark, capsys):
    QUERIES["selection_rules"](spark, SMALL).explain()
    assert capsys.readouterr().out.count("Scan parquet") <= 3
