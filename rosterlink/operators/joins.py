"""Equi-join of many rows to a side that holds each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import stored
from .bitmaps import NUMBERS, as_bitmaps, with_membership
from .sizing import broadcast_limit, fits_broadcast, measured

# A key with more rows than this is spread over several tasks.
ROWS_PER_TASK = 1_000_000


def hot_keys(
    rows: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Hash of every heavy key with the number of tasks it is spread over.

    There are at most as many as all rows make tasks of ``rows_per_task``.
    """
    counts = rows.groupBy(F.xxhash64(*keys).alias("_hot")).agg(F.count("*").alias("_n"))
    heavy = counts.filter(F.col("_n") > rows_per_task)
    return heavy.select("_hot", F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_tasks"))


def _spread_join(
    rows: DataFrame, unique: DataFrame, keys: list[str], how: str, seq: str, rows_per_task: int
) -> DataFrame:
    hot = measured(stored(hot_keys(rows, keys, rows_per_task)))
    tasks = F.coalesce(F.col("_tasks"), F.lit(1))
    left = (
        rows.withColumn("_hot", F.xxhash64(*keys))
        .join(hot, "_hot", "left")
        .withColumn("_slot", F.pmod(F.xxhash64(seq), tasks).cast("int"))
        .drop("_hot", "_tasks")
    )
    right = (
        unique.withColumn("_hot", F.xxhash64(*keys))
        .join(hot, "_hot", "left")
        .withColumn("_slot", F.explode(F.sequence(F.lit(0), tasks - 1)))
        .drop("_hot", "_tasks")
    )
    # The measured size has ruled out a broadcast, whatever the planner estimates.
    return left.join(right.hint("merge"), [*keys, "_slot"], how).drop("_slot")


# Bits of a key bitmap for each key: one row in 16 or so without a match passes.
BITS_PER_KEY = 16


def split_by_keys(
    rows: DataFrame, unique: DataFrame, keys: list[str], bits_per_key: int = BITS_PER_KEY
) -> tuple[DataFrame, DataFrame] | None:
    """Rows whose key may be in ``unique``, and rows whose key certainly is not.

    The keys of ``unique`` are hashed into a bitmap, which is broadcast; no row is moved for it.
    Its size is bounded by half of the session's broadcast threshold. None where
    that leaves less than two bits for a key: then it would tell little.
    """
    most = broadcast_limit(rows) * 4
    n = unique.count()
    bits = min(max(n * bits_per_key, NUMBERS), most) // NUMBERS * NUMBERS
    if bits < max(2 * n, NUMBERS):
        return None
    slot = F.pmod(F.xxhash64(*keys), F.lit(bits)).alias("_slot")
    bitmaps = stored(as_bitmaps(unique.select(slot), "_slot"))
    flagged = with_membership(rows.select("*", slot), "_slot", bitmaps, "_may").drop("_slot")
    return flagged.filter("_may").drop("_may"), flagged.filter("not _may").drop("_may")


def lookup_join(
    rows: DataFrame,
    unique: DataFrame,
    keys: list[str],
    how: str = "left",
    *,
    seq: str = "seq",
    broadcast: bool | None = None,
    spread: bool = True,
    rows_per_task: int = ROWS_PER_TASK,
    reduce: bool = False,
) -> DataFrame:
    """Join ``rows`` with ``unique``, which has one row per key.

    ``unique`` is broadcast when its measured size is below the session's
    threshold. Otherwise both sides are shuffled, and heavy keys of ``rows`` are
    spread over several tasks by a hash of ``seq``, with the matching row of
    ``unique`` repeated for each of them. ``spread=False`` tells that no key of
    ``rows`` can be heavy. With ``reduce`` rows that cannot match are told by a bitmap of the
    keys and are not shuffled; ``rows`` are then read once for each kind.
    """
    if broadcast is None:
        broadcast = fits_broadcast(unique)
    if broadcast:
        return rows.join(F.broadcast(unique), keys, how)
    parts = split_by_keys(rows, unique, keys) if reduce else None
    may = parts[0] if parts else rows
    if spread:
        joined = _spread_join(may, unique, keys, how, seq, rows_per_task)
    else:
        joined = may.join(unique.hint("merge"), keys, how)
    if parts and how in ("left", "left_anti"):
        return joined.unionByName(parts[1], allowMissingColumns=True)
    return joined
