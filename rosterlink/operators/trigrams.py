"""Text search over an index of trigrams: only blocks of rows that can hold the text are read.

Rows are stored once as they come, in blocks of a bounded number of rows. For each searched column
the index lists in which blocks each trigram of the lower-cased text occurs, as ranges of
blocks. A text is looked for in three steps: the number of blocks of each of its trigrams decides
which are the rarest; the blocks that hold all of these in one column are the candidates; the rows of
candidate blocks are tested for the text itself. Texts of fewer than three characters have no trigram,
so all rows are tested.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import stored
from ..functions.text import known
from .filters import SEARCHED, text_filter

WIDTH = 3
ROWS_PER_BLOCK = 4096
# The rarest trigrams of a text that are looked up.
RAREST = 4
# Ranges of blocks that a scan is told; candidates that are many are joined to wider ranges.
MOST_RANGES = 200

BLOCK = "_block"


class TextIndex(NamedTuple):
    """Stored rows with their block, ranges of blocks per trigram, and blocks counted per trigram."""

    rows: DataFrame
    ranges: DataFrame
    totals: DataFrame


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text, an empty list for a shorter one."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (WIDTH - 1), F.lit(1)))
    each = F.transform(places, lambda i: F.substring(text, i, F.lit(WIDTH)))
    return F.filter(F.array_distinct(each), lambda g: F.length(g) == WIDTH)


def _kept(df: DataFrame, path: str | None, name: str, **options: str) -> DataFrame:
    if path is None:
        return stored(df, **options)
    df.write.options(**options).parquet(f"{path}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")


def text_index(
    rows: DataFrame,
    columns: list[str] | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
    path: str | None = None,
) -> TextIndex:
    """Index ``columns`` of all rows; with ``path`` the index lasts, see :func:`open_text_index`.

    Rows are not moved. Trigrams are made distinct per block before they are shuffled.
    """
    columns = columns or SEARCHED
    number = F.monotonically_increasing_id()
    numbered = rows.withColumn(BLOCK, (number / rows_per_block).cast("long"))
    # Pages of a block's rows with their own bounds, so that a scan can skip the others.
    pages = {"parquet.page.row.count.limit": str(rows_per_block)}
    placed = _kept(numbered, path, "rows", **pages)
    fields = F.array(
        *(F.struct(F.lit(c).alias("columna"), F.lower(known(F.col(c))).alias("text")) for c in columns)
    )
    texts = placed.select(BLOCK, F.explode(fields).alias("f")).select(BLOCK, "f.*").distinct()
    grams = texts.select("columna", BLOCK, F.explode(grams_of(F.col("text"))).alias("gram")).distinct()
    in_order = Window.partitionBy("columna", "gram").orderBy(BLOCK)
    runs = grams.withColumn("_run", F.col(BLOCK) - F.row_number().over(in_order))
    ranges = runs.groupBy("columna", "gram", "_run").agg(
        F.min(BLOCK).alias("first"), F.max(BLOCK).alias("last")
    )
    ordered = ranges.drop("_run").repartitionByRange("gram", "columna", "first")
    listed = _kept(ordered.sortWithinPartitions("gram", "columna", "first"), path, "ranges")
    blocks = F.sum(F.col("last") - F.col("first") + 1).alias("blocks")
    totals = listed.groupBy("gram", "columna").agg(blocks).repartitionByRange("gram")
    return TextIndex(placed, listed, _kept(totals.sortWithinPartitions("gram"), path, "totals"))


def open_text_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(*(spark.read.parquet(f"{path}/{name}") for name in TextIndex._fields))


def _lower_grams(spark: SparkSession, text: str) -> list[str]:
    found = spark.range(1).select(grams_of(F.lower(F.lit(text))).alias("g")).first()["g"]
    return list(found)


def candidate_blocks(index: TextIndex, text: str, rarest: int = RAREST) -> DataFrame:
    """Blocks (``_block``) in which one column holds the rarest trigrams of the text.

    At most ``rarest`` trigrams per column pass the driver.
    """
    spark = index.rows.sparkSession
    grams = _lower_grams(spark, text)
    counted = index.totals.filter(F.col("gram").isin(grams))
    by_blocks = Window.partitionBy("columna").orderBy("blocks", "gram")
    known_grams = counted.withColumn("_n", F.count("*").over(Window.partitionBy("columna")))
    # A column that lacks one of the trigrams altogether cannot hold the text.
    whole = known_grams.filter(F.col("_n") == len(grams))
    picked = whole.withColumn("_at", F.row_number().over(by_blocks)).filter(F.col("_at") <= rarest)
    chosen: dict[str, list[str]] = {}
    for r in picked.select("columna", "gram").collect():
        chosen.setdefault(r["columna"], []).append(r["gram"])
    nothing = F.lit(False)
    wanted = nothing
    for column, own in chosen.items():
        wanted = wanted | ((F.col("columna") == column) & F.col("gram").isin(own))
    each = index.ranges.filter(wanted).select(
        "columna", "gram", F.explode(F.sequence("first", "last")).alias(BLOCK)
    )
    needed = min(rarest, len(grams))
    held = each.groupBy("columna", BLOCK).agg(F.count("*").alias("n")).filter(F.col("n") == needed)
    return held.select(BLOCK).distinct()


def _ranges(blocks: DataFrame, most: int) -> list[tuple[int, int]]:
    """At most ``most`` ranges that cover all blocks."""
    low, high = blocks.agg(F.min(BLOCK), F.max(BLOCK)).first()
    if low is None:
        return []
    width = (high - low) // most + 1
    coarse = ((F.col(BLOCK) - low) / width).cast("long").alias("_coarse")
    found = blocks.groupBy(coarse).agg(F.min(BLOCK).alias("a"), F.max(BLOCK).alias("b"))
    return sorted((r["a"], r["b"]) for r in found.select("a", "b").collect())


def search(index: TextIndex, text: str, most_ranges: int = MOST_RANGES) -> DataFrame:
    """The rows that :func:`text_filter` finds, from the blocks that can hold them.

    Which blocks those are is known before the rows are read, so the bounds go to the scan.
    """
    rows = index.rows
    if len(text) >= WIDTH and _lower_grams(rows.sparkSession, text):
        inside = F.lit(False)
        for first, last in _ranges(stored(candidate_blocks(index, text)), most_ranges):
            own = F.col(BLOCK) == first if first == last else F.col(BLOCK).between(first, last)
            inside = inside | own
        rows = rows.filter(inside)
    return text_filter(rows, text).drop(BLOCK)
