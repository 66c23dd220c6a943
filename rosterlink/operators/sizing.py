"""Measured size of a DataFrame, to decide whether it may be broadcast."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Allowance per value and per row for headers and hash-table slots.
VALUE_OVERHEAD = 16
ROW_OVERHEAD = 32

_UNITS = {"": 1, "b": 1, "k": 2**10, "kb": 2**10, "m": 2**20, "mb": 2**20, "g": 2**30, "gb": 2**30}


def _value_bytes(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + VALUE_OVERHEAD
    if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + VALUE_OVERHEAD
    return F.lit(VALUE_OVERHEAD)


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of the in-memory size: one scan, one number to the driver."""
    row = F.lit(ROW_OVERHEAD).cast("long")
    for f in df.schema.fields:
        row = row + _value_bytes(f)
    return df.agg(F.sum(row).alias("n")).first()["n"] or 0


def broadcast_limit(df: DataFrame) -> int:
    """The session's own broadcast threshold in bytes; -1 switches it off."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", text.strip().lower()).groups()
    return int(number) * _UNITS[unit]


def measured(df: DataFrame) -> DataFrame:
    """The small side of a join: broadcast if its measured size allows, else merged."""
    return F.broadcast(df) if fits_broadcast(df) else df.hint("merge")


def fits_broadcast(df: DataFrame) -> bool:
    limit = broadcast_limit(df)
    return limit > 0 and measured_bytes(df) <= limit
