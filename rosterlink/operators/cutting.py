"""Cutting ordered items of known sizes into parts that stay within a bound.

Each part takes items as long as they fit (a greedy cut), as one reader going through the items would
do it, but without one: where a part that starts at an item would end is found for all items at once, from
prefix sums; then the starts that are really reached from the first item are found by doubling pointers, so a
group of any size is cut in rounds that grow with the logarithm of its number of parts. No group is
gathered in a task: prefix sums are made in blocks of positions, and ends are found among the items of two
neighbouring stretches of the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import stored

ITEMS_PER_BLOCK = 10_000


def with_ends(items: DataFrame, group: list[str], pos: str, size: str, per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """Add ``_end``: the sum of sizes up to and with each item of its group, by position (from 1)."""
    blocked = items.withColumn("_block", ((F.col(pos) - 1) / per_block).cast("long"))
    inside = Window.partitionBy(*group, "_block").orderBy(pos)
    summed = blocked.withColumn("_inside", F.sum(size).over(inside))
    totals = blocked.groupBy(*group, "_block").agg(F.sum(size).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    return (
        summed.join(offsets, [*group, "_block"])
        .withColumn("_end", F.col("_inside") + F.col("_before"))
        .drop("_block", "_inside", "_before")
    )


def _following(ends: DataFrame, group: list[str], pos: str, size: str, bound: Column) -> DataFrame:
    """``group, pos, next``: where the part after one that starts at ``pos`` starts."""
    end, own = F.col("_end"), bound.cast("long")
    stretch = F.floor(end / own)
    start = end - F.col(size)
    # An item can end a part whose limit lies in its own stretch or in the next one.
    item = F.struct(end.alias("at"), F.lit(0).alias("kind"), F.col(pos).alias("pos"))
    limit = F.struct((start + own).alias("at"), F.lit(1).alias("kind"), F.col(pos).alias("pos"))
    rows = F.array(
        F.struct(stretch.alias("stretch"), item.alias("e")),
        F.struct((stretch + 1).alias("stretch"), item.alias("e")),
        F.struct(F.floor((start + own) / own).alias("stretch"), limit.alias("e")),
    )
    events = ends.select(*group, F.inline(rows)).select(*group, "stretch", "e.*")
    sofar = (
        Window.partitionBy(*group, "stretch")
        .orderBy("at", "kind", "pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last = F.max(F.when(F.col("kind") == 0, F.col("pos"))).over(sofar)
    found = events.withColumn("_last", last).filter("kind = 1")
    # An item above the bound is a part of its own.
    return found.select(*group, "pos", (F.greatest(F.col("_last"), F.col("pos")) + 1).alias("next"))


def greedy_parts(
    items: DataFrame,
    group: list[str],
    pos: str,
    size: str,
    bound: Column | int,
    per_block: int = ITEMS_PER_BLOCK,
) -> DataFrame:
    """``group, pos, parte``: the part, from 1, of every item.

    ``pos`` numbers the items of a group from 1 without gaps; sizes are whole and not negative.
    ``bound`` is one number or the same for all items of a group. A part's sizes add up to ``bound`` at most; an item larger
    than it is a part alone. Groups must not be null.
    """
    limit = bound if isinstance(bound, Column) else F.lit(bound)
    narrow = stored(
        items.select(*group, F.col(pos).cast("long").alias("pos"), F.col(size).cast("long").alias("size"), limit.cast("long").alias("_limit"))
    )
    keys = [*group, "pos"]
    ends = stored(with_ends(narrow, group, "pos", "size", per_block))
    most = ends.groupBy(*group).agg(F.max("pos").alias("_most"))
    chain = _following(ends, group, "pos", "size", F.col("_limit")).join(most, group)
    chain = stored(chain.filter(F.col("next") <= F.col("_most")).drop("_most"))
    starts = stored(most.select(*group, F.lit(1).cast("long").alias("pos")))
    count = starts.count()
    # After each round the starts are the first 2, 4, 8 ... of each group, and the pointers lead as far.
    while True:
        reached = starts.join(chain, keys).select(*group, F.col("next").alias("pos"))
        starts = stored(starts.union(reached).distinct())
        before, count = count, starts.count()
        if count == before:
            break
        onward = chain.select(*group, F.col("pos").alias("next"), F.col("next").alias("_far"))
        chain = stored(chain.join(onward, [*group, "next"]).select(*keys, F.col("_far").alias("next")))
    in_order = Window.partitionBy(*group).orderBy("pos")
    parts = starts.select(
        *group, "pos", F.row_number().over(in_order).cast("long").alias("parte"), F.lead("pos").over(in_order).alias("_stop")
    ).join(most, group)
    held = F.sequence(F.col("pos"), F.coalesce(F.col("_stop") - 1, F.col("_most")))
    return parts.select(*group, "parte", F.explode(held).alias("pos"))
