"""Every registered query against its DuckDB oracle on the smallest data set."""

import pytest

from spendlake.plans import REGISTRY
from tests.conftest import SF_DIR
from tests.oracle import compare, connect

#: Queries that find nothing in the months of the smallest data set are run on the next one.
LARGER = "/root/testdata/sf0.01"
SPARSE = {"A4_focus_categories", "A4_focus_rolled_up", "J3_focus_join", "A20_recurring_patterns", "A20_top_recurring", "D4_recurring_transactions"}


@pytest.fixture(scope="module")
def connections():
    return {sf_dir: connect(sf_dir) for sf_dir in (SF_DIR, LARGER)}


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, connections, name):
    sf_dir = LARGER if name in SPARSE else SF_DIR
    rows, problem = compare(spark, connections[sf_dir], REGISTRY[name], sf_dir)
    assert not problem
    assert rows > 0
