import pytest

from tests.oracle import compare
from tracewell import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()
#: The whole ranking takes a minute; test_batch.py runs it on a few rows.
LONG = {"key_players", "ranked_by_broker", "disruption"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert compare(spark, "/root/testdata/sf0.01", QUERIES[name], ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - LONG))
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0
