"""Parts within a bound against one reader who goes through the items."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rosterlink.operators.cutting import greedy_parts, with_ends
from rosterlink.operators.lookup import lookup
from rosterlink.sinks.payload import payloads


def one_by_one(sizes, bound):
    parts, part, total = [], 0, None
    for s in sizes:
        if total is None or total + s > bound:
            part, total = part + 1, 0
        total += s
        parts.append(part)
    return parts


@pytest.mark.parametrize("seed, bound, per_block", [(1, 50, 7), (2, 1, 100), (3, 1000, 3), (4, 13, 10_000)])
def test_equals_one_reader(spark, seed, bound, per_block):
    r = random.Random(seed)
    groups = {g: [r.choice([0, 1, r.randrange(30), r.randrange(200)]) for _ in range(r.choice([1, 2, 60, 500]))] for g in "abcde"}
    rows = [(g, i + 1, s) for g, sizes in groups.items() for i, s in enumerate(sizes)]
    items = spark.createDataFrame(rows, "g string, n int, bytes int").repartition(5)
    made = {(x.g, x.pos): x.parte for x in greedy_parts(items, ["g"], "n", "bytes", bound, per_block).collect()}
    want = {(g, i + 1): p for g, sizes in groups.items() for i, p in enumerate(one_by_one(sizes, bound))}
    assert made == want
    totals = {(x.g, x.n): x["_end"] for x in with_ends(items, ["g"], "n", "bytes", per_block).collect()}
    assert totals == {(g, i + 1): sum(sizes[: i + 1]) for g, sizes in groups.items() for i in range(len(sizes))}


def test_bound_of_each_group_and_no_items(spark):
    rows = [("a", i, 1, 3) for i in range(1, 11)] + [("b", i, 1, 4) for i in range(1, 11)]
    items = spark.createDataFrame(rows, "g string, n int, s int, most int")
    made = greedy_parts(items, ["g"], "n", "s", F.col("most"))
    counted = {(r.g, r.parte): r["count"] for r in made.groupBy("g", "parte").count().collect()}
    assert counted == {("a", 1): 3, ("a", 2): 3, ("a", 3): 3, ("a", 4): 1, ("b", 1): 4, ("b", 2): 4, ("b", 3): 2}
    assert greedy_parts(items.limit(0), ["g"], "n", "s", 5).count() == 0


@pytest.mark.parametrize("bound", [600, 1500, 10**6])
def test_payloads_within_bytes(spark, bound):
    roster = spark.createDataFrame(
        [(i, f"{i:04d}ñ", f"name {'x' * (i * 7 % 90)} \"{i}\"", "ca;rgo", "área") for i in range(40)],
        "seq long, dni string, nombre string, cargo string, area string",
    )
    rows = spark.createDataFrame([(i, f"{i % 50}ñ", f"ref{i % 3}") for i in range(200)], "seq long, dni string, ref string")
    shown = lookup(rows, roster)
    sent = payloads(shown, F.col("ref"), max_bytes=bound).collect()
    whole = {r.IdRef: json.loads(r.payload) for r in payloads(shown, F.col("ref"), per_payload=10**6).collect()}
    for ref, expected in whole.items():
        own = sorted((r for r in sent if r.IdRef == ref), key=lambda r: r.parte)
        people = [p for r in own for p in json.loads(r.payload)["participantes"]]
        assert people == expected["participantes"] and [r.parte for r in own] == list(range(1, len(own) + 1))
        assert all(len(r.payload.encode()) <= bound for r in own)
        # No part could have taken the first participant of the next one.
        for r, after in zip(own, own[1:], strict=False):
            first = json.dumps(json.loads(after.payload)["participantes"][0], separators=(",", ":"), ensure_ascii=False)
            assert len(r.payload.encode()) + 1 + len(first.encode()) > bound
