"""Explicit positions in a total order, without a one-task window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import stored


def numbered(
    df: DataFrame, order: list[Column], group: list[str] | None = None, column: str = "pos"
) -> DataFrame:
    """Number rows from 1 by ``order``, over all rows or inside each ``group``.

    Rows are range-partitioned by group and order, so a large group spans
    several sorted partitions. Each partition adds the row counts of the group's
    earlier partitions, one number per partition. The sorted rows are stored
    first, because sampled range bounds may differ between two evaluations.
    """
    group = group or []
    by = [*(F.col(g) for g in group), *order]
    sheets = stored(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_sheet", F.spark_partition_id())
        .withColumn("_line", F.monotonically_increasing_id())
    )
    counts = sheets.groupBy("_sheet", *group).agg(
        F.count("*").alias("_n"), F.min("_line").alias("_first")
    )
    earlier = (
        Window.partitionBy(*group)
        .orderBy("_sheet")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        "_sheet",
        *group,
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    if not group:
        # One row per partition of the sort.
        offsets = F.broadcast(offsets)
    # A null group is a group like any other.
    keys = ["_sheet", *group]
    offsets = offsets.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    return (
        sheets.join(offsets, same)
        .withColumn(column, F.col("_line") + F.col("_shift"))
        .drop("_line", "_shift", "_sheet", *(f"_of_{k}" for k in keys))
    )
