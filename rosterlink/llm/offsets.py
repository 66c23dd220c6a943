"""Global offsets from the totals of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_global_start(
    rows: DataFrame, part: str = "part", local: str = "local_start", n: str = "n_tokens"
) -> DataFrame:
    """Add ``global_start``: the sum of ``n`` over all rows before each one.

    ``rows`` is a stored table whose partitions when it was written are numbered in
    ``part`` and hold their own running sum in ``local``. The first pass adds up
    the partitions, the second adds each partition's offset. The totals are one
    row per partition, whatever the number of rows: they are ranked in one task
    and broadcast.
    """
    totals = rows.groupBy(part).agg(F.sum(n).alias("_sum"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    joined = rows.join(F.broadcast(offsets), part)
    return joined.withColumn("global_start", F.col("_before") + F.col(local)).drop("_before")


def windows_of(start: Column, n: Column, width: int) -> Column:
    """Numbers of the windows of ``width`` that ``n >= 1`` items from ``start`` touch."""
    return F.sequence(F.floor(start / width), F.floor((start + n - 1) / width))
