"""Registered queries of the subpackage on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from contentgauge.llm.queries import ORACLES, QUERIES
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_over_its_whole_table(spark, name):
    con = connect(FOLDER)
    if name.startswith("op11"):  # a report of the best phrases: compared with SQL, its rows are not the table's
        status, _, _, note = compare(spark, con, name, QUERIES[name], ORACLES[name], FOLDER)
        assert status == "ok", f"{status}: {note}"
        return
    status, rows, _, note = compare(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert status in ("ok", "rows-only"), f"{status}: {note}"
    table, extra = {"op2": ("embeddings", 0), "op5": ("(select distinct conv_id from conversations)", 1), "op10": ("pages", 0)}.get(
        name.split("_")[0], ("documents", 0))
    want = con.execute(f"select count(*) from {table}").fetchall()[0][0] + extra
    assert rows == want if not name.startswith("op9") else rows >= want


def test_all_operations_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_duckdb_is_there():
    assert duckdb.connect().execute("select 1").fetchall() == [(1,)]
