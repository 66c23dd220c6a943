"""Facet bitmaps against filters over the rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rosterlink.operators.facets import facet_counts, facet_index, facet_rows, passing_count
from rosterlink.operators.filters import facet_filter

r = random.Random(8)
DATA = [
    (i, r.choice("xyz"), r.choice(["a", "b", "", None]), f"n{r.randrange(900)}", "FUERA" if i % 7 else "OK")
    for i in range(5000)
]
SCHEMA = "seq long, area string, cargo string, nombre string, estado string"
COLUMNS = ["area", "cargo", "nombre", "estado"]
FACETS = [
    {},
    {"area": []},
    {"area": ["x"]},
    {"area": ["x", "z"], "cargo": ["a", "b"]},
    {"area": ["y"], "nombre": [f"n{i}" for i in range(40)], "estado": ["OK"]},
    {"cargo": [""]},
    {"area": ["none"], "estado": ["OK"]},
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(DATA, SCHEMA).fillna("", ["cargo"]).repartition(3, "seq").cache()


@pytest.fixture(scope="module", params=[1, 300, 10**6])
def index(rows, request):
    return facet_index(rows, COLUMNS, dense=request.param)


@pytest.mark.parametrize("facets", FACETS)
def test_rows_and_counts(rows, index, facets):
    want = sorted(map(tuple, facet_filter(rows, facets).collect()))
    found = facet_rows(index, facets)
    assert found.columns == rows.columns and sorted(map(tuple, found.collect())) == want
    assert passing_count(index, facets).first()["n"] == len(want)
    for column in ("area", "nombre"):
        others = {c: v for c, v in facets.items() if c != column}
        counted = Counter(row[column] for row in facet_filter(rows, others).collect())
        values = {row[column] for row in rows.select(column).collect()} - {""}
        got = {row["valor"]: row["n"] for row in facet_counts(index, column, facets).collect()}
        assert got == {v: counted[v] for v in values}


def test_counts_do_not_read_the_rows(index):
    for df in (facet_counts(index, "area", {"cargo": ["a"]}), passing_count(index, {"area": ["x"]})):
        assert not {f.rsplit("/", 1)[0] for f in df.inputFiles()} & {f.rsplit("/", 1)[0] for f in index.rows.inputFiles()}


def test_no_rows(rows):
    none = facet_index(rows.filter(F.lit(False)), COLUMNS)
    assert facet_counts(none, "area").count() == 0
    assert passing_count(none, {"area": ["x"]}).first()["n"] == 0
    assert facet_rows(none, {}).count() == 0
