import pytest
from pyspark.sql import functions as F

from rosterlink.operators.joins import hot_keys, lookup_join, split_by_keys
from rosterlink.operators.lookup import lookup, roster_index, status, summary
from rosterlink.operators.sizing import broadcast_limit, fits_broadcast, measured_bytes


@pytest.fixture(scope="module")
def roster(spark):
    return spark.createDataFrame(
        [
            (3, "007", "Second", "c", "a"),
            (1, "7", "First", "c1", "a1"),
            (5, "000", "Nobody", "c", "a"),
            (6, " 012", "Kept zero", "c", "a"),
        ],
        "seq long, dni string, nombre string, cargo string, area string",
    )


@pytest.fixture(scope="module")
def rows(spark):
    data = [(0, "0007 "), (1, "7"), (2, "8"), (3, ""), (4, "12"), (5, None), (6, "\t012")]
    data += [(10 + i, "7") for i in range(50)]
    return spark.createDataFrame(data, "seq long, dni string")


EXPECTED = {0: "First", 1: "First", 2: None, 3: "Nobody", 4: None, 5: "Nobody", 6: "Kept zero"} | {
    10 + i: "First" for i in range(50)
}


@pytest.mark.parametrize("broadcast", [True, False, None])
@pytest.mark.parametrize("rows_per_task", [4, 1_000_000])
def test_lookup(spark, rows, roster, broadcast, rows_per_task):
    def run(how):
        return lookup(rows, roster, how, broadcast=broadcast, rows_per_task=rows_per_task)

    left = run("left").select("seq", "oficial.nombre").collect()
    assert len(left) == len(EXPECTED)
    assert {r["seq"]: r["nombre"] for r in left} == EXPECTED
    hit = {s for s, n in EXPECTED.items() if n}
    assert {r["seq"] for r in run("inner").collect()} == hit
    assert sorted(r["seq"] for r in run("left_semi").collect()) == sorted(hit)
    assert sorted(r["seq"] for r in run("left_anti").collect()) == sorted(EXPECTED.keys() - hit)


@pytest.mark.parametrize("broadcast", [True, False])
def test_summary(spark, rows, roster, broadcast):
    assert tuple(summary(rows, roster, broadcast=broadcast).first()) == (57, 2)
    none = rows.filter(F.lit(False))
    assert tuple(summary(none, roster, broadcast=broadcast).first()) == (0, 0)


def test_empty_roster(spark, rows, roster):
    none = roster.filter(F.lit(False))
    assert tuple(summary(rows, none).first()) == (57, 57)
    states = lookup(rows, none).select(status().alias("s")).distinct().collect()
    assert [r["s"] for r in states] == ["FUERA"]


def test_index_keeps_first_row(spark, roster):
    got = {r["llave"]: r["oficial"]["nombre"] for r in roster_index(roster).collect()}
    assert got == {"7": "First", "": "Nobody", "012": "Kept zero"}


def test_hot_keys_bound_every_task(spark, rows):
    hot = {r["_hot"]: r["_tasks"] for r in hot_keys(rows, ["dni"], 10).collect()}
    assert list(hot.values()) == [6]
    joined = lookup_join(
        rows.na.fill("", ["dni"]),
        spark.createDataFrame([("7", "x")], "dni string, v string"),
        ["dni"],
        broadcast=False,
        rows_per_task=10,
    )
    assert joined.filter("v = 'x'").count() == 51 and joined.count() == 57


def test_sizes(spark, roster):
    assert measured_bytes(roster) > 4 * (7 + 4)
    assert measured_bytes(roster.filter(F.lit(False))) == 0
    assert measured_bytes(roster.select(F.struct("seq", "dni").alias("s"))) > 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for text, limit in [("10MB", 10 * 2**20), ("-1", -1), ("1k", 1024), ("2097152b", 2**21)]:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
            assert broadcast_limit(roster) == limit
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50b")
        assert not fits_broadcast(roster)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_every_hot_key_is_spread(spark):
    """Many heavy keys: none is left out, and the join stays right."""
    rows = spark.range(6000).select(F.col("id").alias("seq"), (F.col("id") % 300).alias("k"))
    unique = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_keys(rows, ["k"], rows_per_task=7)
    assert hot.count() == 300 and {r["_tasks"] for r in hot.collect()} == {3}
    joined = lookup_join(rows, unique, ["k"], broadcast=False, rows_per_task=7)
    assert joined.count() == 6000 and joined.filter("v is null or v != 2 * k").count() == 0


def shuffled_rows(df):
    """Records written by each exchange of the plan that ran."""
    plan = df._jdf.queryExecution().executedPlan()
    found, waiting = [], [plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan]
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        if "QueryStage" in node.nodeName():
            waiting.append(node.plan())
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return found


def test_rows_that_cannot_match_are_not_shuffled(spark):
    rows = spark.range(40_000).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 20 == 0, F.col("id")).otherwise(-F.col("id")).alias("k")
    )
    unique = spark.range(40_000).select(F.col("id").alias("k"), F.struct((F.col("id") * 2).alias("v")).alias("s"))
    may, never = split_by_keys(rows, unique, ["k"])
    kept = may.count()
    assert kept + never.count() == 40_000 and 2000 <= kept < 6000
    for how, want in (("left", 40_000), ("inner", 2000), ("left_semi", 2000), ("left_anti", 38_000)):
        plain = lookup_join(rows, unique, ["k"], how, broadcast=False)
        made = lookup_join(rows, unique, ["k"], how, broadcast=False, reduce=True)
        assert made.columns == plain.columns
        got = sorted(made.select("seq").toPandas()["seq"]) if how != "left" else None
        assert got is None or got == sorted(plain.select("seq").toPandas()["seq"])
        assert made.count() == want == plain.count()
    left = lookup_join(rows, unique, ["k"], "left", broadcast=False, reduce=True).select("seq", "k", "s.v")
    assert left.filter("(v is null) = (k >= 0) or v != 2 * k").count() == 0
    many = lookup_join(rows, unique, ["k"], "left_anti", broadcast=False, spread=False, reduce=True)
    many.collect()
    exchanged = shuffled_rows(many)
    assert sorted(exchanged) == sorted([kept, 40_000]), exchanged


def test_no_bitmap_without_room_for_it(spark):
    unique = spark.range(1000).select(F.col("id").alias("k"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in ("-1", "1k"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            assert split_by_keys(unique, unique, ["k"]) is None
            made = lookup_join(unique, unique, ["k"], "left_anti", seq="k", broadcast=False, reduce=True)
            assert made.count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
