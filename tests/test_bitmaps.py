"""Sets of numbers as bitmaps."""

import random

from pyspark.sql import functions as F

from rosterlink.operators.bitmaps import as_bitmaps, with_membership


def test_membership(spark):
    r = random.Random(2)
    members = {0, 1, 7, 8, 32767, 32768, 5 * 2**33 + 3} | {r.randrange(200_000) for _ in range(5000)}
    numbers = spark.createDataFrame([(n,) for n in members], "n long").repartition(3)
    bitmaps = as_bitmaps(numbers, "n")
    assert bitmaps.agg(F.sum(F.bitmap_count("bitmap"))).first()[0] == len(members)
    asked = sorted(members | {r.randrange(200_000) for _ in range(5000)} | {5 * 2**33, 6 * 2**33 + 3})
    rows = spark.createDataFrame([(n, "x") for n in asked], "number long, bitmap string")
    made = {row.number: row.inside for row in with_membership(rows, "number", bitmaps, "inside").collect()}
    assert made == {n: n in members for n in asked}
    none = with_membership(rows, "number", as_bitmaps(numbers.limit(0), "n"), "inside")
    assert none.filter("inside").count() == 0 and none.count() == len(asked)


def test_groups(spark):
    numbers = spark.createDataFrame([("a", 1), ("a", 40_000), ("b", 1)], "g string, n long")
    made = as_bitmaps(numbers, "n", ["g"]).select("g", "bucket", F.bitmap_count("bitmap").alias("c")).collect()
    assert sorted(map(tuple, made)) == [("a", 0, 1), ("a", 1, 1), ("b", 0, 1)]
