"""Every query against its SQL, over the small tables."""

import pytest

from ledgerloom.queries import ORACLES, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001")


def test_all_queries_run(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
