import random

import pytest
from pyspark.sql import functions as F

from rosterlink.functions import text as t

SPACE = t.WHITE_SPACE


def toggled(line):
    """Row-wise model of the quote-toggling split."""
    fields, now, inside = [], "", False
    for c in line:
        if c == '"':
            inside = not inside
        elif c == "," and not inside:
            fields.append(now.strip(SPACE))
            now = ""
        else:
            now += c
    return [*fields, now.strip(SPACE)]


def split_all(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    parts = df.withColumn("p", t.split_quoted(F.col("x")))
    clean = F.transform("p", lambda f: t.full_trim(F.translate(f, '"', "")))
    return [r["c"] for r in parts.select("i", clean.alias("c")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "line, fields",
    [
        ('"a,b",c', ["a,b", "c"]),
        ('"a ""b"" c",d', ["a b c", "d"]),
        ('a,b"c,d"e', ["a", "bc,de"]),
        ('"unclosed,a,b', ["unclosed,a,b"]),
        ("x,,", ["x", "", ""]),
        ("a\u0001b, c ", ["a\u0001b", "c"]),
    ],
)
def test_split_quoted(spark, line, fields):
    assert split_all(spark, [line]) == [fields]
    assert toggled(line) == fields


def test_split_quoted_equals_model(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice('ab,," \t ') for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    lines.append('"' + "x,y" * 20000 + '",' + 'a"b"' * 5000)
    assert split_all(spark, lines) == [toggled(x) for x in lines]


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "dni, key",
    [(" 012", "012"), ("0012 ", "12"), ("000", ""), ("", ""), (None, ""), ("﻿7\r", "7"), ("00 7", "7")],
)
def test_identity_key(spark, dni, key):
    assert value(spark, t.identity_key(F.col("d")), d=dni) == key


def test_full_trim(spark):
    assert value(spark, t.full_trim(F.col("c")), c=SPACE + "a b" + SPACE) == "a b"
    assert value(spark, t.full_trim(F.col("c")), c="​a") == "​a"
    assert len(SPACE) == len(set(SPACE)) == 25


@pytest.mark.parametrize(
    "name, stem", [("A1.jpeg", "a1"), (".jpg", ""), ("B.C.D", "b"), ("NoDot", "nodot"), ("", "")]
)
def test_file_stem(spark, name, stem):
    assert value(spark, t.file_stem(F.col("n")), n=name) == stem


@pytest.mark.parametrize(
    "content, query, marked",
    [
        ("a.b axb", "a.b", "<mark>a.b</mark> axb"),
        ("ÉL él", "é", "<mark>É</mark>L <mark>é</mark>l"),
        ("abc", "", "abc"),
        ("q\\Eq", "\\e", "q<mark>\\E</mark>q"),
        ("$1", "$", "<mark>$</mark>1"),
    ],
)
def test_highlight(spark, content, query, marked):
    assert value(spark, t.highlight(F.col("c"), query), c=content) == marked


def test_accepted_edits(spark):
    df = spark.range(4, 41)
    for r in df.select("id", t.accepted_edits(F.col("id").cast("int")).alias("t")).collect():
        assert r["t"] == max(3, int(r["id"] * 0.25))


def test_single_line_base64(spark):
    import base64

    content = bytes(range(256))
    df = spark.createDataFrame([(content,)], "c binary")
    assert df.select(t.single_line_base64(F.col("c"))).first()[0] == base64.b64encode(content).decode()


def test_participant_id(spark):
    df = spark.range(2000)
    ids = [r[0] for r in df.select(t.participant_id(F.lit("ref"), F.col("id"))).collect()]
    assert all(i[0] == "x" and 1 <= len(i) - 1 <= 6 and i[1:] == i[1:].upper() for i in ids)
    assert len(set(ids)) > 1990
    assert ids == [r[0] for r in df.select(t.participant_id(F.lit("ref"), F.col("id"))).collect()]
