"""Sets of numbers as bitmaps: one of 4,096 bytes for each 32,768 numbers that hold a member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizing import measured

# Fixed value of the bitmap functions: numbers that one bitmap stands for.
NUMBERS = 32_768


def bucket_of(number: Column) -> Column:
    """The bitmap that a number from 0 on belongs to."""
    return (number.cast("long") - F.pmod(number.cast("long"), F.lit(NUMBERS))) / NUMBERS


def place_of(number: Column) -> Column:
    return F.pmod(number.cast("long"), F.lit(NUMBERS))


def as_bitmaps(numbers: DataFrame, column: str, groups: list[str] | None = None) -> DataFrame:
    """``bucket`` and ``bitmap`` of all numbers in a column, for each of ``groups``.

    Combined before the shuffle.
    """
    keyed = numbers.withColumn("bucket", bucket_of(F.col(column)).cast("long"))
    return keyed.groupBy(*(groups or []), "bucket").agg(
        F.bitmap_construct_agg(place_of(F.col(column))).alias("bitmap")
    )


def holds(bitmap: Column, number: Column) -> Column:
    """Whether a number is in the bitmap of its bucket; false where there is none."""
    place = place_of(number)
    octet = F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))
    bits = F.conv(F.hex(octet), 16, 10).cast("int")
    power = F.pow(F.lit(2), F.pmod(place, F.lit(8))).cast("int")
    return F.coalesce(bits.bitwiseAND(power) != 0, F.lit(False))


def with_membership(rows: DataFrame, number: str, bitmaps: DataFrame, flag: str) -> DataFrame:
    """Add ``flag``: whether the row's number is in the set. Rows stay where they are as long as
    the measured size of the bitmaps (an eighth of a byte for each number) allows a broadcast."""
    own = bitmaps.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap"))
    keyed = rows.withColumn("_bucket", bucket_of(F.col(number)).cast("long"))
    joined = keyed.join(measured(own), "_bucket", "left")
    return joined.withColumn(flag, holds(F.col("_bitmap"), F.col(number))).drop("_bucket", "_bitmap")
