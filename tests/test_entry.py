"""The driver contract, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from checks.compare import compare

SMALL = "/root/testdata/sf0.001"
NAMES = ["parse_all", "patterns", "history", "rolling_rate", "heartbeat", "incidents", "alerts",
         "incident_context", "snapshot", "state_merge"]

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="driver tables not present")


def test_every_query_has_sql():
    own = set(contract.queries()) - set(contract.LLM)
    assert own == set(contract.oracle_sql()) - set(contract.LLM_SQL)


def test_entry(spark):
    assert contract.entry(spark).columns == ["source", "pattern", "level", "count"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    equal, text = compare(spark, SMALL, name)
    assert equal, text
