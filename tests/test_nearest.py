"""The name link against a row-wise model of its rule."""

import random

import pytest
from pyspark.sql import functions as F

from rosterlink.functions.text import search_name
from rosterlink.operators.nearest import (
    FEW_PAIRS,
    KEY,
    PAIRS_PER_TASK,
    _query_keys,
    _roster_keys,
    _signatures,
    _verified,
    link_by_name,
    link_count,
    nearest_names,
    roster_names,
)


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def model(query, names):
    """(distance, seq) of the accepted name, names as (seq, lower-case name)."""
    best = min(((distance(query, n), seq) for seq, n in names), default=None)
    if best and best[0] <= max(3, len(query) // 4):
        return best
    return None


def mistyped(rng, name, edits, letters):
    name = list(name)
    for _ in range(edits):
        at = rng.randrange(len(name) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            name.insert(at, rng.choice(letters))
        elif at < len(name):
            if kind == 1:
                del name[at]
            else:
                name[at] = rng.choice(letters)
    return "".join(name)


def sample(seed, letters, shortest, longest, n_names, n_queries):
    rng = random.Random(seed)
    names = ["".join(rng.choice(letters) for _ in range(rng.randint(shortest, longest))) for _ in range(n_names)]
    queries = {
        mistyped(rng, rng.choice(names), rng.randint(0, 9), letters).strip() for _ in range(n_queries)
    }
    return names, sorted(q for q in queries if len(q) >= 4)


def frames(spark, names, queries):
    roster = spark.createDataFrame(
        [(i, f"{i:08d}", n) for i, n in enumerate(names)], "seq long, dni string, nombre string"
    )
    asked = spark.createDataFrame([(q,) for q in queries], "consulta string")
    return asked, roster_names(roster)


def found(df):
    return {r["consulta"]: (r["d"], r["primero"]["seq"]) for r in df.collect()}


@pytest.mark.parametrize(
    "letters, shortest, longest, pairs",
    [
        ("ab", 0, 9, PAIRS_PER_TASK),
        ("ab", 0, 9, 1),
        ("abc ", 3, 22, PAIRS_PER_TASK),
        ("abc ", 3, 22, 30),
        ("abcdefghij ", 12, 40, PAIRS_PER_TASK),
        ("abcdefghij ", 12, 40, 1),
        ("ana lopez", 30, 64, 10),
    ],
)
def test_nearest_equals_model(spark, letters, shortest, longest, pairs):
    size = 60 if pairs > 40 else 30
    few = FEW_PAIRS if pairs == PAIRS_PER_TASK else 0
    names, queries = sample(f"{letters}{pairs}", letters, shortest, longest, size, size)
    asked, people = frames(spark, names, queries)
    ordered = [(i, n.lower()) for i, n in enumerate(names)]
    expected = {q: m for q in queries if (m := model(q, ordered))}
    assert found(nearest_names(asked, people, pairs_per_task=pairs, few_pairs=few)) == expected


def test_common_part(spark):
    """All names share a long part, so they are cut finer and the rest goes in blocks."""
    rng = random.Random(5)
    names = [f"rodriguez {mistyped(rng, 'garcia perez', 5, 'abcdeir')}" for _ in range(40)]
    queries = sorted({mistyped(rng, n, rng.randint(2, 8), "abcdeir") for n in names})
    asked, people = frames(spark, names, queries)
    ordered = list(enumerate(names))
    expected = {q: m for q in queries if (m := model(q, ordered))}
    assert found(nearest_names(asked, people, pairs_per_task=60, few_pairs=0)) == expected


def test_steps_do_not_change_the_result(spark):
    names, queries = sample(7, "abcd ", 6, 30, 50, 50)
    asked, people = frames(spark, names, queries)
    stepwise = found(nearest_names(asked, people, few_pairs=0))
    assert stepwise == found(nearest_names(asked, people, steps=(None,), few_pairs=0))
    assert stepwise == found(nearest_names(asked, people))
    assert stepwise


def rows_of(spark, data):
    return spark.createDataFrame(
        [(i, str(i), n, d, "", "", "A1.jpeg", m) for i, (n, d, m) in enumerate(data)],
        "seq long, nro string, nombre string, dni string, ocupacion string, area string, "
        "sourceFile string, method string",
    )


def test_link_rules(spark):
    roster = spark.createDataFrame(
        [
            (0, "7", "Ana Lopez", "c", "a"),
            (1, "007", "Ana Lopes", "c", "a"),
            (2, "9", "Bob Marley", "c", "a"),
            (3, "11", "anax", "c", "a"),
        ],
        "seq long, dni string, nombre string, cargo string, area string",
    )
    rows = rows_of(
        spark,
        [
            ("ANA LOPEZ ", "x1", "DEFAULT"),  # equal after trim and lower
            ("Ana Lopes", "x2", "MANUAL"),  # still unmatched, so MANUAL gives way
            ("Ana Lopet", "x3", "DEFAULT"),  # tie: first roster row
            ("ana", "x4", "DEFAULT"),  # too short
            ("Zzzzzzzzz Qqqq", "x5", "DEFAULT"),  # nothing near
            ("Ana Lopez", "0007", "DEFAULT"),  # matched already
            ("Ana Lopez", "x7", "DEFAULT"),
        ],
    )
    for broadcast in (True, False):
        linked = link_by_name(rows, roster, broadcast=broadcast)
        got = {r["seq"]: (r["dni"], r["method"], r["vinculado"]) for r in linked.collect()}
        assert got == {
            0: ("7", "IA", True),
            1: ("007", "IA", True),
            2: ("7", "IA", True),
            3: ("x4", "DEFAULT", False),
            4: ("x5", "DEFAULT", False),
            5: ("0007", "DEFAULT", False),
            6: ("7", "IA", True),
        }
        assert link_count(linked).first()[0] == 4


def test_threshold(spark):
    """At the limit of its length a name is linked, one edit further it is not."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    limits = {4: 3, 15: 3, 16: 4, 19: 4, 20: 5, 23: 5, 24: 6}
    names = [letters[:n] for n in limits]
    expected = {}
    queries = []
    for i, (n, limit) in enumerate(limits.items()):
        at, beyond = (f"{'0' * k}{letters[k:n]}" for k in (limit, limit + 1))
        expected[at] = (limit, i)
        queries += [at, beyond] if limit + 1 < n else [at]
    asked, people = frames(spark, names, queries)
    assert found(nearest_names(asked, people)) == {
        q: m for q in queries if (m := model(q, list(enumerate(names))))
    }
    for q, m in expected.items():
        assert model(q, list(enumerate(names)))[0] == m[0]


def test_empty_sides(spark):
    asked, people = frames(spark, ["abcde"], ["abcdf"])
    none = people.filter(F.lit(False))
    assert found(nearest_names(asked, none)) == {}
    assert found(nearest_names(asked.filter(F.lit(False)), people)) == {}


def test_search_name(spark):
    df = spark.createDataFrame([("  ÉVA\t",)], "n string")
    assert df.select(search_name(F.col("n"))).first()[0] == "éva"


def test_join_is_on_shared_parts(spark):
    asked, people = frames(spark, ["abcdefgh", "ijklmnop"], ["abcdefgx"])
    names = people.withColumns(_signatures("n", "nombre"))
    asked = asked.withColumns(_signatures("q", "consulta"))
    pairs = _verified(_query_keys(asked, None, 0), _roster_keys(names, None, [8], 0), KEY)
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_code" in text
    for operator in ("EvalPython", "CartesianProduct", "NestedLoop"):
        assert operator not in text
