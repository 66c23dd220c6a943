"""Corrections by differences against making the view again."""

import random
from collections import Counter

import pytest
from test_lookup import shuffled_rows

from rosterlink.operators.edits import apply_corrections
from rosterlink.plans import corrected, keep, kept_summary, view

COLUMNS = ["seq", "nombre", "dni", "area", "method", "estado", "dni_oficial", "nombre_oficial"]


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(9)
    roster = spark.createDataFrame(
        [(i, f"{i:04d}", f"name {i}", "c", f"z{i % 3}") for i in range(60)] + [(90, "7", "later", "c", "z")],
        "seq long, dni string, nombre string, cargo string, area string",
    )
    rows = spark.createDataFrame(
        [(i, f"n{i}", r.choice([None, str(r.randrange(100))]), r.choice(["x", "y", None]), "DEFAULT") for i in range(400)],
        "seq long, nombre string, dni string, area string, method string",
    )
    logs = [
        spark.createDataFrame(
            [(r.randrange(420), t, r.choice([None, "", str(r.randrange(100))])) for t in range(n)], "seq long, t int, dni string"
        )
        for n in (1, 30, 200)
    ]
    return rows, roster, logs


@pytest.mark.parametrize("broadcast", [None, False])
def test_equals_a_view_made_again(spark, data, broadcast):
    rows, roster, logs = data
    kept = keep(rows, roster, ["area", "method"])
    for log in logs:
        kept = corrected(kept, log, "t", roster, broadcast=broadcast)
        rows = apply_corrections(rows, log, "t")
        want = view(rows, roster).select(*COLUMNS).collect()
        assert sorted(map(tuple, kept.rows.select(*COLUMNS).collect())) == sorted(map(tuple, want))
        counts = Counter((c, row[c]) for row in want for c in ("area", "method", "estado"))
        assert {(r.columna, r.valor): r.n for r in kept.counts.collect()} == counts
        assert tuple(kept_summary(kept).first()) == (400, counts["estado", "FUERA"])
    none = corrected(kept, logs[0].limit(0), "t", roster)
    assert none.rows.count() == 400 and none.counts.count() == kept.counts.count()


@pytest.mark.parametrize("broadcast", [True, False])
def test_rows_that_are_not_corrected_stay(spark, data, broadcast):
    rows, roster, logs = data
    kept = keep(rows, roster, ["area"])
    after = corrected(kept, logs[1], "t", roster, broadcast=broadcast).rows
    after.select("seq", "estado").collect()
    moved = shuffled_rows(after.select("seq", "estado")) if broadcast else []
    assert not moved
    touched_rows = after.filter("method = 'MANUAL'").count()
    assert 0 < touched_rows <= 30


def test_view_of_nothing(data):
    rows, roster, logs = data
    kept = corrected(keep(rows.limit(0), roster, ["area"]), logs[1], "t", roster)
    assert kept.rows.count() == 0 and tuple(kept_summary(kept).first()) == (0, 0)
