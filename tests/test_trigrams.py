"""Search through the index against the filter over all rows."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterlink.operators import trigrams
from rosterlink.operators.filters import text_filter

SCHEMA = "seq long, nombre string, dni string, sourceFile string, other string"


def made_rows():
    r = random.Random(6)

    def text(n):
        return "".join(r.choices("abñÁ 1.İß🙂", k=r.randrange(n)))

    rows = [(i, text(14), None if i % 9 == 0 else text(6), f"A{i % 30}.jpeg", "x") for i in range(600)]
    return rows + [(1000, "Straße needle ΣΑΣ", "", "", "needle"), (1001, "", "", "", "needle"), (1002, None, None, None, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made_rows(), SCHEMA).repartition(4, "seq").cache()


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "text")
    trigrams.text_index(rows, rows_per_block=16, path=path)
    return trigrams.open_text_index(rows.sparkSession, path)


def seqs(df):
    return sorted(r["seq"] for r in df.select("seq").collect())


@pytest.mark.parametrize("text", ["", "a", "ab", "needle", "NEEDLE Σ", "ße n", "no such text", "A1.jpeg", ".JPEG", "1.İ", "🙂🙂🙂", "   "])
def test_same_rows_as_the_filter(rows, index, text):
    assert seqs(trigrams.search(index, text)) == seqs(text_filter(rows, text))
    assert trigrams.search(index, text).columns == rows.columns


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.data())
def test_random_pieces_of_the_rows(rows, index, data):
    source = data.draw(st.sampled_from([x for row in made_rows() for x in row[1:4] if x]))
    a = data.draw(st.integers(0, len(source)))
    text = source[a : a + data.draw(st.integers(1, 7))].swapcase()
    got = trigrams.search(index, text, most_ranges=data.draw(st.sampled_from([1, 3, 200])))
    assert seqs(got) == seqs(text_filter(rows, text))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_scan_is_told_the_blocks(rows, index):
    total = rows.count()
    blocks = trigrams.candidate_blocks(index, "needle").count()
    assert blocks == 1 < index.rows.select("_block").distinct().count()
    found = trigrams.search(index, "needle")
    assert "PushedFilters" in plan(found) and "EqualTo(_block" in plan(found)
    read = index.rows.filter(F.col("_block").isin([r[0] for r in trigrams.candidate_blocks(index, "needle").collect()]))
    assert read.count() <= 16 < total


def test_no_rows(rows):
    none = trigrams.text_index(rows.limit(0))
    assert trigrams.search(none, "needle").count() == 0 and trigrams.search(none, "").count() == 0
