"""Every registered query next to its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from contentgauge.plans.catalog import ORACLES, QUERIES
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
# nothing in 200 documents or 50 pages reaches these
MAY_BE_EMPTY = {"f08_refill", "k13_cell_correlation", "d14_presence_contrast"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    status, rows, _, note = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert status in ("ok", "rows-only") or (status == "EMPTY" and name in MAY_BE_EMPTY), f"{status}: {note}"


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
