"""Registered queries against their SQL at the smallest scale, and their plans."""

from pathlib import Path

import pytest
from compare import connection, difference
from pyspark.sql import DataFrameWriter

from rosterlink.catalog import QUERIES
from rosterlink.oracle import oracle_sql

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == oracle_sql().keys()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


UNWANTED = ("BatchEvalPython", "ArrowEvalPython", "MapIn", "CartesianProduct", "NestedLoop")


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name, monkeypatch):
    """The result, and the plans of all steps that are stored on the way to it."""
    legs, write = [], DataFrameWriter.parquet

    def noted(self, *args, **options):
        legs.append(plan(self._df))
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    assert difference(spark, con, FOLDER, name) == ""
    if name.startswith(("sort_", "nearest_", "link_", "reconcile_", "payload_", "request_")):
        assert legs
    for leg in legs:
        assert not any(operator in leg for operator in UNWANTED)


@pytest.mark.parametrize("name", ["lookup_left", "lookup_anti", "view_placeholder", "export_lines"])
def test_small_roster_is_broadcast(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "BroadcastHashJoin [llave" in text
    assert "SortMergeJoin" not in text


LAZY = [q for q in QUERIES if not q.startswith(("nearest_", "link_", "reconcile_"))]


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_pairs(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert not any(operator in text for operator in UNWANTED)


def test_payloads_are_parsed(spark):
    """The text is stored in between, so that the planner cannot leave the parsing out."""
    assert "from_json" in plan(QUERIES["payload_roundtrip"](spark, FOLDER))
