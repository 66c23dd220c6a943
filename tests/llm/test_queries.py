"""Registered queries against their SQL; those without SQL are tested in other files."""

from pathlib import Path

import __spark_entry__
import pytest
from compare import connection, difference

import corpus_pipeline
from rosterlink.llm.queries import QUERIES, SQL

FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]

pytestmark = pytest.mark.skipif(not Path(FOLDERS[0]).exists(), reason="no test tables")


@pytest.mark.parametrize("folder", FOLDERS)
@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, folder, name):
    assert difference(spark, connection(folder), folder, name) == ""


def test_all_operators_and_the_pipeline():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    registered = __spark_entry__.queries()
    assert QUERIES.items() <= registered.items() and registered["pipeline"] is corpus_pipeline.run


def test_url_filter_runs_no_python(spark):
    plan = QUERIES["op1_url_filter"](spark, FOLDERS[0])._jdf.queryExecution().executedPlan().toString()
    for operator in ("Python", "Arrow", "ExistingRDD", "Cartesian", "NestedLoop"):
        assert operator not in plan
    assert "html" not in plan
