"""URL filter by host and path rules: a sort-merge range join.

A host's canonical key is its labels in reverse order, each followed by a dot:
``www.example.com`` gives ``com.example.www.``. All subdomains of a rule's host then
lie in one interval of keys, from the rule's key to its last possible extension, and
intervals of different rules are either nested or apart. Rules become border events,
each with the stack of rules that are active from there on. Events and urls are
sorted together by key; a sweep hands every url the stack of the last border
before it, in which the longest rule whose path fits decides.

The urls are dealt evenly over slices by their places in the input, each sorted and swept by
itself with all borders, so a host, or one url repeated, that holds any share of the rows does no
harm, and a url row is shuffled once. Slices grow in number with the rows. Borders (two for each host that has a rule) are repeated per slice.
A stack holds the rules of one host and of the hosts above it: its size depends
on the rule list, not on the urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Sorts after every other character in UTF-8.
LAST = "\U0010ffff"

# Urls that one slice gets, about.
ROWS_PER_SLICE = 500_000

# A url that no rule fits.
DEFAULT_VERDICT = "allow"

_RULE = "size int, host_size int, block boolean, rule string, path string"


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules given as ``("block", "example.com/en/")``: verdict and host with path."""
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for v, r in rules]
    none = F.expr("cast(array() as array<struct<rule: string, verdict: string>>)")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else none))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(_part(url, "[/?#]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.substring(_part(url, "[?#]"), F.length(_part(url, "[/?#]")) + 1, F.lit(2**31 - 1))


def _part(url: Column, until: str) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1)))
    return F.coalesce(F.split(rest, until, 2)[0], F.lit(""))


def canonical(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "."), F.lit("."))


def borders(rules: DataFrame) -> DataFrame:
    """``key``, ``stack``: the rules active from each border on.

    At the start of a host's interval the stack holds its rules and those of all hosts
    above it; at the end, those of the hosts above. Both come from an equi-join of
    hosts with the hosts above them, of which a host has as many as it has labels.
    """
    cut = F.split("rule", "/", 2)
    host = F.lower(cut[0])
    parsed = rules.filter("rule is not null and verdict is not null").select(
        canonical(host).alias("host_key"),
        F.struct(
            F.length("rule").alias("size"),
            F.length(host).alias("host_size"),
            (F.col("verdict") == "block").alias("block"),
            F.col("rule"),
            F.substring("rule", F.length(host) + 1, F.lit(2**31 - 1)).alias("path"),
        ).alias("entry"),
    )
    by_host = parsed.groupBy("host_key").agg(F.collect_set("entry").alias("entries"))
    labels = F.split("host_key", "[.]", -1)
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1),
        lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")),
    )
    chains = by_host.select(F.col("host_key").alias("of"), F.explode(above).alias("host_key"))
    stacks = (
        chains.join(by_host, "host_key")
        .groupBy("of")
        .agg(
            F.flatten(F.collect_list("entries")).alias("inside"),
            F.flatten(
                F.collect_list(F.when(F.col("host_key") != F.col("of"), F.col("entries")))
            ).alias("outside"),
        )
    )
    start = F.struct(F.col("of").alias("key"), F.col("inside").alias("stack"))
    end = F.struct(
        F.concat("of", F.lit(LAST)).alias("key"),
        F.coalesce("outside", F.expr(f"cast(array() as array<struct<{_RULE}>>)")).alias("stack"),
    )
    return stacks.select(F.inline(F.array(start, end)))


def judged(
    pages: DataFrame,
    rules: DataFrame,
    default: str = DEFAULT_VERDICT,
    id_column: str = "page_id",
    slices: int | None = None,
) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict``.

    A rule fits its host and all its subdomains if the url's path starts with the
    rule's path. The longest rule (in characters) wins; at a tie the one with the
    longer host, then a blocking one. No rule: ``rule`` is null and the verdict is
    ``default``. A url that is null or has no ``://`` has empty host and path, which
    no rule fits. Rows that repeat, or whose id is null, are judged like any other.
    Rules with a null part are no rules. Extra columns are ignored.
    """
    spark = pages.sparkSession
    if slices is None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        slices = max(least, -(-pages.count() // ROWS_PER_SLICE))
    url = F.col("url")
    urls = pages.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slices)).cast("int").alias("slice"),
        canonical(host_of(url)).alias("key"),
        F.lit(1).alias("is_url"),
        F.lit(None).cast(f"array<struct<{_RULE}>>").alias("stack"),
        F.col(id_column).alias("id"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
    )
    events = borders(rules).select(
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
        "key",
        F.lit(0).alias("is_url"),
        "stack",
        F.lit(None).cast(pages.schema[id_column].dataType).alias("id"),
        F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("path"),
    )
    sweep = (
        Window.partitionBy("slice")
        .orderBy("key", "is_url")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    swept = urls.unionByName(events).withColumn("active", F.last("stack", True).over(sweep))
    fitting = F.filter("active", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(fitting)
    verdict = F.when(best["block"], "block").when(~best["block"], "allow").otherwise(default)
    return swept.filter("is_url = 1").select(
        F.col("id").alias(id_column),
        "host",
        "path",
        best["rule"].alias("rule"),
        verdict.alias("verdict"),
    )
