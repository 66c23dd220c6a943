"""Sorted positions stored once, so that a page of any sort reads its own rows only.

Rows are stored as they come, with a number each. For every sortable column a narrow table holds, for each row
number, its position in ascending and in descending order; equal values keep the row order in both. Tables
are stored in order of the ascending position, with page bounds, so a range of positions is a small part of a file.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import stored
from ..functions.text import known
from .joins import lookup_join
from .ranking import numbered

_NUMBER = "_number"

# Rows in a page of a file: the least that a scan reads.
ROWS_PER_PAGE = 4096
_PAGES = {"parquet.page.row.count.limit": str(ROWS_PER_PAGE)}


class OrderIndex(NamedTuple):
    """Stored rows with ``_number``, and per column ``_number``, ``asc`` and ``desc``."""

    rows: DataFrame
    orders: dict[str, DataFrame]


def _positions(rows: DataFrame, column: str, seq: str) -> DataFrame:
    narrow = rows.select(_NUMBER, F.col(seq).alias("seq"), F.lower(known(F.col(column))).alias("key"))
    placed = stored(numbered(narrow, [F.col("key").asc(), F.col("seq").asc()], column="asc").drop("seq"))
    # Downwards, groups of equal values come in reverse, and stay as they are inside.
    groups = stored(placed.groupBy("key").agg(F.min("asc").alias("first"), F.max("asc").alias("last")))
    total = groups.agg(F.coalesce(F.max("last"), F.lit(0))).first()[0]
    joined = lookup_join(placed, groups, ["key"], "inner", seq="asc")
    back = F.lit(total) - F.col("last") + F.col("asc") - F.col("first") + 1
    both = joined.select(_NUMBER, "asc", back.alias("desc"))
    return stored(both.repartitionByRange("asc").sortWithinPartitions("asc"), **_PAGES)


def order_index(rows: DataFrame, columns: list[str], seq: str = "seq") -> OrderIndex:
    """Positions of all rows by each of ``columns``; the rows themselves are not sorted or moved."""
    kept = stored(rows.withColumn(_NUMBER, F.monotonically_increasing_id()), **_PAGES)
    return OrderIndex(kept, {c: _positions(kept, c, seq) for c in columns})


def page(index: OrderIndex, column: str, direction: str = "asc", first: int = 1, count: int = 100) -> DataFrame:
    """The rows at positions ``first`` to ``first + count - 1``, with ``pos``.

    The numbers of the page's rows, ``count`` at most, pass the driver, so the scan is told them.
    """
    place = F.col("asc" if direction == "asc" else "desc")
    wanted = index.orders[column].filter(place.between(first, first + count - 1))
    numbers = {r[_NUMBER]: r["pos"] for r in wanted.select(_NUMBER, place.alias("pos")).collect()}
    if not numbers:
        return index.rows.filter(F.lit(False)).withColumn("pos", F.lit(0).cast("long")).drop(_NUMBER)
    spark = index.rows.sparkSession
    listed = spark.createDataFrame(sorted(numbers.items()), f"{_NUMBER} long, pos long")
    own = index.rows.filter(F.col(_NUMBER).isin(sorted(numbers)))
    return own.join(F.broadcast(listed), _NUMBER).drop(_NUMBER)
