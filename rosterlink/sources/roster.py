"""Official roster from comma-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import stored
from ..functions.text import is_blank, quoted_field, split_quoted
from ..operators.sizing import fits_broadcast

# Position of each roster column in the comma line.
COLUMNS = {"dni": 0, "nombre": 5, "cargo": 8, "area": 9}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and their order.

    The copy is stored because line numbers depend on how Spark cuts the files,
    which may change with the executors at hand.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    at = F.struct(
        F.col("_metadata.file_path").alias("archivo"),
        F.col("_metadata.file_block_start").alias("bloque"),
        F.monotonically_increasing_id().alias("fila"),
    )
    return stored(
        lines.select(
            F.col("value").alias("line"), F.col("_metadata.file_path").alias("archivo"), at.alias("seq")
        )
    )


def parse_roster(lines: DataFrame) -> DataFrame:
    """Roster rows from ``line`` and ``seq``, and ``archivo`` if there are several files.

    Blank lines are dropped, then the first line of each file, unread; short
    lines are padded with empty fields and rows without dni are dropped.
    """
    if "archivo" not in lines.columns:
        lines = lines.withColumn("archivo", F.lit(""))
    written = lines.filter(~is_blank(F.col("line")))
    headers = written.groupBy("archivo").agg(F.min("seq").alias("seq"))
    if fits_broadcast(headers):
        headers = F.broadcast(headers)
    body = written.join(headers, ["archivo", "seq"], "left_anti")
    parts = body.select("seq", split_quoted(F.col("line")).alias("_parts"))
    people = parts.select(
        "seq", *(quoted_field(F.col("_parts"), i).alias(c) for c, i in COLUMNS.items())
    )
    return people.filter(F.col("dni") != "")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return parse_roster(read_lines(spark, path))
