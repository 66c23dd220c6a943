"""Pages of stored orders against sorting all rows."""

import random

import pytest
from pyspark.sql import functions as F

from rosterlink.operators.filters import sort_order
from rosterlink.operators.order_index import order_index, page

r = random.Random(3)
DATA = [(i, r.choice(["ana", "ANA", "Bob", "", None, "ñu"]), r.choice("ab"), "x") for i in range(700)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(DATA, "seq long, nombre string, estado string, pos_ string").repartition(4).cache()


@pytest.fixture(scope="module")
def index(rows):
    return order_index(rows, ["nombre", "estado"])


@pytest.mark.parametrize("column", ["nombre", "estado"])
@pytest.mark.parametrize("direction", ["asc", "desc"])
@pytest.mark.parametrize("first, count", [(1, 10), (347, 100), (695, 100), (701, 5), (1, 700)])
def test_pages(rows, index, column, direction, first, count):
    order = [x["seq"] for x in rows.orderBy(*sort_order(column, direction)).collect()]
    found = page(index, column, direction, first, count)
    made = sorted((x["pos"], x["seq"]) for x in found.collect())
    assert made == [(i + 1, order[i]) for i in range(first - 1, min(first - 1 + count, 700))]
    assert [c for c in found.columns if c != "pos"] == rows.columns


def test_the_scans_are_told_the_page(index):
    found = page(index, "nombre", "desc", 11, 3)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "In(_number" in text.split("PushedFilters")[1] or "In(" in text
    narrow = index.orders["nombre"].filter(F.col("desc").between(11, 13))
    assert "nombre" not in narrow._jdf.queryExecution().executedPlan().toString()


def test_no_rows(rows):
    none = order_index(rows.limit(0), ["nombre"])
    assert page(none, "nombre").count() == 0
