import random

import pytest
from pyspark.sql import functions as F

from rosterlink.operators.filters import (
    facet_filter,
    facet_values,
    only_unmatched,
    roster_search,
    sort_order,
    text_filter,
)
from rosterlink.operators.ranking import numbered
from rosterlink.plans import ordered, view

ROWS = [
    (0, "1", "ana a.b", "7", "op", "X", "A1.jpeg", "DEFAULT"),
    (1, "2", "Bob", "8", "OP", "Y", "A2.jpeg", "MANUAL"),
    (2, "3", "ANA", "9", "op", "Y", "a1.jpeg", "IA"),
    (3, "4", "axb", "10", "", "X", "", "DEFAULT"),
    (4, "5", "bob", "07", "op", "Z", "A1.jpeg", "DEFAULT"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        ROWS,
        "seq long, nro string, nombre string, dni string, ocupacion string, area string, "
        "sourceFile string, method string",
    )


@pytest.fixture(scope="module")
def roster(spark):
    data = [(i, f"{i:08d}", f"Person {i}", "c", "a") for i in range(1, 10)]
    data += [(100 + i, f"9{i:02d}", f"X {i}", "c", "a") for i in range(20)]
    return spark.createDataFrame(data, "seq long, dni string, nombre string, cargo string, area string")


def seqs(df):
    return sorted(r["seq"] for r in df.collect())


@pytest.mark.parametrize(
    "text, expected",
    [("a.b", [0]), ("A1", [0, 2, 4]), (" ", [0]), ("", [0, 1, 2, 3, 4]), ("BO", [1, 4]), ("(", [])],
)
def test_text_filter(rows, text, expected):
    assert seqs(text_filter(rows, text)) == expected


def test_facets(rows, roster):
    assert seqs(facet_filter(rows, {"ocupacion": ["op"], "area": ["X", "Z"]})) == [0, 4]
    assert seqs(facet_filter(rows, {"ocupacion": []})) == [0, 1, 2, 3, 4]
    assert seqs(view(rows, roster, facets={"estado": ["OK", "FUERA"]})) == [0, 1, 2, 3, 4]
    assert seqs(view(rows, roster, facets={"estado": ["FUERA"]})) == [3]
    assert seqs(view(rows, roster, only_unmatched=True)) == seqs(only_unmatched(rows, roster)) == [3]
    assert seqs(view(rows, roster, only_unmatched=True, facets={"estado": ["OK"]})) == []


def test_view_columns(rows, roster):
    got = {r["seq"]: r for r in view(rows, roster, text="a", marks=True).collect()}
    assert got[3]["estado"] == "FUERA" and got[3]["dni_oficial"] == got[3]["nombre_oficial"] == "---"
    assert got[0]["nombre_oficial"] == "Person 7" and got[0]["dni_oficial"] == "00000007"
    assert got[0]["nombre_marcado"] == "<mark>a</mark>n<mark>a</mark> <mark>a</mark>.b"


@pytest.mark.parametrize(
    "column, direction, expected",
    [
        ("nombre", "asc", [2, 0, 3, 1, 4]),
        ("nombre", "desc", [1, 4, 3, 0, 2]),
        ("sourceFile", "desc", [1, 0, 2, 4, 3]),
        ("estado", "asc", [3, 0, 1, 2, 4]),
        ("estado", "desc", [0, 1, 2, 4, 3]),
        (None, "asc", [0, 1, 2, 3, 4]),
    ],
)
def test_sort(rows, roster, column, direction, expected):
    shown = view(rows, roster)
    assert [r["seq"] for r in ordered(shown, column, direction).collect()] == expected
    placed = ordered(shown, column, direction, positions=True).collect()
    assert [r["seq"] for r in sorted(placed, key=lambda r: r["pos"])] == expected


def test_facet_values(rows):
    assert [r[0] for r in facet_values(rows, "sourceFile").collect()] == ["A1.jpeg", "A2.jpeg", "a1.jpeg"]
    states = facet_values(rows, "estado", positions=True)
    assert states.dtypes == facet_values(rows, "nombre", positions=True).dtypes
    assert [tuple(r) for r in states.collect()] == [("OK", 1), ("FUERA", 2)]


def test_roster_search(roster):
    assert [r["seq"] for r in roster_search(roster, "000").collect()] == [*range(1, 10), 100]
    assert roster_search(roster, " \t").count() == 0
    assert [r["seq"] for r in roster_search(roster, " person 3 ").collect()] == [3]
    assert [r["seq"] for r in roster_search(roster, "0091").collect()] == [110 + i for i in range(10)]


def test_numbered(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("aaaab"), rng.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(data, "seq long, g string, v int").repartition(7)
    whole = numbered(df, [F.col("v").desc(), F.col("seq").asc()]).collect()
    want = sorted(data, key=lambda r: (-r[2], r[0]))
    assert [r["seq"] for r in sorted(whole, key=lambda r: r["pos"])] == [r[0] for r in want]
    assert sorted(r["pos"] for r in whole) == list(range(1, 3001))
    grouped = numbered(df, sort_order(None), ["g"]).collect()
    for g in "ab":
        mine = sorted((r["pos"], r["seq"]) for r in grouped if r["g"] == g)
        assert mine == list(enumerate(sorted(r[0] for r in data if r[1] == g), 1))
