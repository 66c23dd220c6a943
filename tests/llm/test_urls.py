"""The URL filter against a look at every rule for every url."""

import random

import pytest
from pyspark.sql import functions as F

from rosterlink.llm import urls

RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "a.b.net/"),
    ("allow", "b.net/e"),
    ("block", "b.net/e"),
    ("block", "xample.com/"),
    ("allow", "com/very/long/path"),
    ("block", "EXAMPLE.org/"),
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends)] if ends else rest
    ends = [rest.find(c) for c in "?#" if c in rest]
    path = (rest[: min(ends)] if ends else rest)[len(host) :]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def expected(url, rules, default="allow"):
    host, path = parts(url)
    fitting = []
    for verdict, rule in rules:
        own = rule.split("/", 1)[0].lower()
        rest = rule[len(own) :]
        if (host == own or host.endswith("." + own)) and path.startswith(rest):
            fitting.append((len(rule), len(own), verdict == "block", rule, verdict))
    if not fitting:
        return host, path, None, default
    return host, path, max(fitting)[3], max(fitting)[4]


def some_urls():
    random.seed(3)
    hosts = ["com", "example.com", "www.Example.com", "m.www.example.com", "notexample.com", "net",
             "a.b.net", "c.a.b.net", "b.net", "ab.net", "example.org", "com.example", "", "é.com",
             "x..com", ".com", "example.com:80", "u@example.com", "a.com\U0010ffff", "z.com.net"]
    paths = ["", "/", "/en/", "/en", "/en/x?y#z", "/es/1#", "?q=/en/", "#/en/", "/e", "/very/long/path/x",
             "/a://b.net/e", "/%65n/"]
    made = [f"{s}://{h}{p}" for s in ("http", "HTTPS", "") for h in hosts for p in paths]
    return [*made, None, "", "no url", "example.com/en/", "http:/x.com/", "x" * 5000 + "://a.b.net/" + "y" * 5000]


@pytest.mark.parametrize("slices", [1, 5])
@pytest.mark.parametrize("default", ["allow", "block"])
def test_against_every_rule(spark, slices, default):
    rows = [(i, u, "h", "r", 1) for i, u in enumerate(some_urls() * 2)] + [(None, "http://a.com/", "h", "r", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, slice int")
    made = urls.judged(pages, urls.rules_table(spark, RULES), default, slices=slices).collect()
    got = sorted(((r.page_id is None, r.page_id), (r.host, r.path, r.rule, r.verdict)) for r in made)
    assert got == sorted(((i is None, i), expected(u, RULES, default)) for i, u, *_ in rows)


def test_no_rules_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = urls.rules_table(spark, [])
    assert [tuple(r) for r in urls.judged(pages, none).collect()] == [(1, "a.com", "/", None, "allow")]
    rules = urls.rules_table(spark, RULES)
    assert urls.judged(pages.filter(F.lit(False)), rules).count() == 0
    broken = spark.createDataFrame([(None, "block"), ("com/", None)], "rule string, verdict string")
    assert urls.judged(pages, broken).first().verdict == "allow"


def test_repeated_rows_and_null_ids_are_spread(spark):
    """Rows with nothing to tell them apart meet in no common slice."""
    pages = spark.range(8000, numPartitions=40).select(
        F.lit(None).cast("long").alias("page_id"), F.lit("http://example.com/en/").alias("url")
    )
    made = urls.judged(pages, urls.rules_table(spark, RULES), slices=8)
    spread = [r[1] for r in made.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(spread) == 8000 and len(spread) > 1 and max(spread) < 4000
    assert {r.verdict for r in made.select("verdict").distinct().collect()} == {"block"}


def test_slices_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(urls, "ROWS_PER_SLICE", 50)
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://a.b.net/").alias("url"))
    made = urls.judged(pages, urls.rules_table(spark, RULES))
    assert made.filter("verdict = 'block'").count() == 3000
    assert "explode(sequence(0, 59" in made._jdf.queryExecution().analyzed().toString()
