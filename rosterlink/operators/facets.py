"""Facets answered from bitmaps: which rows hold a value, without reading the rows.

Rows are stored once with a number each. For every indexed column and value the index has the set of numbers of its
rows, in buckets of 32,768: a bitmap where a bucket holds many of them, else a list of places. Selected
values of one column are united, columns are intersected, and members are counted, all on
bitmaps (``bitmaps.py``), bucket by bucket, so neither a frequent value nor many values make a large group.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import stored
from ..functions.text import known
from .bitmaps import bucket_of, holds, place_of, with_membership
from .sizing import measured

# From so many rows of a bucket on a value has a bitmap there; below, the list is smaller.
DENSE = 1024

_NUMBER = "_number"


class FacetIndex(NamedTuple):
    """Stored rows with their number, and the sets: ``columna, valor, bucket``, ``n`` members, and
    ``bitmap`` or ``places``."""

    rows: DataFrame
    sets: DataFrame
    columns: tuple[str, ...]


def facet_index(rows: DataFrame, columns: list[str], dense: int = DENSE) -> FacetIndex:
    """Index the values of ``columns``; missing text is an empty value. Rows are not moved."""
    numbered = stored(rows.withColumn(_NUMBER, F.monotonically_increasing_id()))
    fields = F.array(
        *(F.struct(F.lit(c).alias("columna"), known(F.col(c)).alias("valor")) for c in columns)
    )
    each = numbered.select(_NUMBER, F.explode(fields).alias("f")).select(
        "f.*", bucket_of(F.col(_NUMBER)).cast("long").alias("bucket"), place_of(F.col(_NUMBER)).cast("int").alias("place")
    )
    keys = ["columna", "valor", "bucket"]
    large = stored(each.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= dense)).select(*keys)
    some = each.join(measured(large), keys, "left_semi").groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.bitmap_construct_agg("place").alias("bitmap"),
        F.lit(None).cast("array<int>").alias("places"),
    )
    few = each.join(measured(large), keys, "left_anti").groupBy(*keys).agg(
        F.count("*").alias("n"), F.lit(None).cast("binary").alias("bitmap"), F.collect_list("place").alias("places")
    )
    return FacetIndex(numbered, stored(some.unionByName(few)), tuple(columns))


def _united(sets: DataFrame, keys: list[str]) -> DataFrame:
    """One bitmap of all members for each of ``keys``."""
    listed = sets.filter("places is not null").select(*keys, F.explode("places").alias("place"))
    made = listed.groupBy(*keys).agg(F.bitmap_construct_agg("place").alias("bitmap"))
    whole = sets.filter("bitmap is not null").select(*keys, "bitmap").unionByName(made)
    return whole.groupBy(*keys).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def passing(index: FacetIndex, facets: dict[str, list[str]]) -> DataFrame:
    """``bucket`` and ``bitmap`` of the rows that hold a selected value in every column.

    A column without selected values does not filter.
    """
    chosen = {c: list(v) for c, v in facets.items() if v}
    if not chosen:
        return _united(index.sets.filter(F.col("columna") == index.columns[0]), ["bucket"])
    wanted = reduce(
        lambda a, b: a | b,
        ((F.col("columna") == c) & F.col("valor").isin(v) for c, v in chosen.items()),
    )
    of_columns = _united(index.sets.filter(wanted), ["columna", "bucket"])
    both = of_columns.groupBy("bucket").agg(
        F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("columns")
    )
    return both.filter(F.col("columns") == len(chosen)).select("bucket", "bitmap")


def passing_count(index: FacetIndex, facets: dict[str, list[str]]) -> DataFrame:
    """How many rows pass, in one row ``n``."""
    counted = passing(index, facets).agg(F.sum(F.bitmap_count("bitmap")).alias("n"))
    return counted.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def facet_counts(index: FacetIndex, column: str, facets: dict[str, list[str]] | None = None) -> DataFrame:
    """Each non-empty value (``valor``) of a column with the rows ``n`` that hold it and pass the facets of all
    other columns. Only the sets are read."""
    others = {c: v for c, v in (facets or {}).items() if c != column and v}
    own = index.sets.filter((F.col("columna") == column) & (F.col("valor") != ""))
    if not others:
        return own.groupBy("valor").agg(F.sum("n").cast("long").alias("n"))
    base = stored(passing(index, others)).withColumnRenamed("bitmap", "base")
    joined = own.join(measured(base), "bucket", "left")
    listed = joined.filter("places is not null").select(
        "valor", F.size(F.filter("places", lambda p: holds(F.col("base"), p))).cast("long").alias("n")
    )
    both = (
        joined.filter("bitmap is not null and base is not null")
        .select("valor", "bucket", F.explode(F.array("bitmap", "base")).alias("b"))
        .groupBy("valor", "bucket")
        .agg(F.bitmap_and_agg("b").alias("b"))
        .select("valor", F.bitmap_count("b").alias("n"))
    )
    none = own.select("valor", F.lit(0).cast("long").alias("n"))
    counted = listed.unionByName(both).unionByName(none)
    return counted.groupBy("valor").agg(F.sum("n").cast("long").alias("n"))


def facet_rows(index: FacetIndex, facets: dict[str, list[str]]) -> DataFrame:
    """The rows that pass, where they are stored."""
    found = stored(passing(index, facets))
    return with_membership(index.rows, _NUMBER, found, "_passes").filter("_passes").drop("_passes", _NUMBER)
