"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.durable import stored


def _state(links: DataFrame) -> tuple:
    low = F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(2**32 - 1)))
    return tuple(links.agg(F.count("*"), low).first())


def components(links: DataFrame) -> DataFrame:
    """``id``, ``component``: the smallest id reachable, for each id in ``links(a, b)``.

    In each round every node hands its larger neighbours, then its smaller ones, to
    the smallest node it knows, until all hang on the roots. Rounds grow with the
    logarithm of the longest chain. Minima are combined before the shuffle; a node
    with very many links is split by the skew handling of the join. Each round is
    stored in the shared folder; only a count and a checksum reach the driver. Links with a null end,
    and of an id with itself, are ignored.
    """
    proper = links.filter("a != b")
    edges = stored(proper.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(roots, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.union(roots).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    # Stored, so that a join with many members of one component can be split.
    leaves = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    own = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stored(leaves.union(own))


def with_components(members: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``component`` to rows with ``id`` and ``first``.

    ``first`` is the smallest id of the class of equal rows that a row belongs to, null for
    a row that links with nothing; ``links(a, b)`` are between such ids. Copies thus take no
    part in the rounds above. Classes that share an id are linked by it.
    """
    several = (
        members.filter("first is not null")
        .groupBy("id")
        .agg(F.min("first").alias("low"), F.max("first").alias("high"))
        .filter("low < high")
    )
    bridges = members.join(several, "id").select(F.col("first").alias("a"), F.col("low").alias("b"))
    found = components(links.union(bridges)).withColumnRenamed("id", "first")
    return members.join(found, "first", "left").withColumn(
        "component", F.coalesce("component", "first", "id")
    )
