"""Comparing all rows that share a key, in blocks of bounded size.

A key's rows are dealt over as many blocks as their total size needs, and each pair of
blocks is one unit of work, so neither a hot key nor a long row piles up in one task.
Units are small, and a task streams through many of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(
    rows: DataFrame,
    keys: list[str],
    item: str,
    size: Column,
    most: int,
    sized: DataFrame | None = None,
) -> DataFrame:
    """Each row once for every unit that its block takes part in.

    Adds ``lower`` and ``upper``, the blocks of the unit, and ``own``, the row's block.
    A block holds about ``most`` of ``size``; keys with one row only are left out.
    ``item`` deals the rows over the blocks. ``sized`` may give the keys and sizes of the
    same rows where they are cheaper to get.
    """
    sizes = (rows if sized is None else sized).groupBy(*keys).agg(F.count("*").alias("_rows"), F.sum(size).alias("_size"))
    counts = sizes.filter("_rows > 1").select(
        *keys, F.ceil(F.col("_size") / most).cast("int").alias("_blocks")
    )
    own = F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return (
        rows.join(counts, keys)
        .withColumn("own", own)
        .withColumn("_other", other)
        .withColumn("lower", F.least("own", "_other"))
        .withColumn("upper", F.greatest("own", "_other"))
        .drop("_blocks", "_other")
    )


def per_unit(
    rows: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table | None], schema: str
) -> DataFrame:
    """Run ``work`` on the rows of each unit of ``block_pairs``, one unit at a time."""
    units = [*keys, "lower", "upper"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _runs(batches, units):
            made = work(unit)
            if made is not None and made.num_rows:
                yield from made.to_batches()

    return rows.repartition(*units).sortWithinPartitions(*units).mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, also across batches."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [
            batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys
        ]
        changed = np.zeros(batch.num_rows, dtype=bool)
        for column in columns:
            changed[1:] |= np.asarray(column[1:] != column[:-1], dtype=bool)
        borders = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for begin, end in zip(borders, borders[1:], strict=False):
            own = tuple(column[begin] for column in columns)
            if waiting and own != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(begin, end - begin))
            last = own
    if waiting:
        yield pa.Table.from_batches(waiting)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Root of each of ``n`` items linked by the pairs: the lowest item of its group."""
    root = np.arange(n)
    while left.size:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(before, root):
            return root
    return root


def shared_values(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Matrix of the number of values that each two of ``n`` rows share.

    ``values`` and ``rows`` list which row holds which value, once each. Values that
    many rows hold are counted by a matrix product, the others pair by pair.
    """
    common = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    size = np.diff(np.concatenate((first, [len(values)])))
    dense = size > max(8, n // 16)
    begin, count = first[dense], size[dense]
    for at in range(0, len(begin), 1024):
        held = np.zeros((n, min(1024, len(begin) - at)), dtype=np.float32)
        for column, (b, c) in enumerate(zip(begin[at : at + 1024], count[at : at + 1024], strict=True)):
            held[rows[b : b + c], column] = 1
        common += held @ held.T
    begin, count = first[~dense], size[~dense]
    while True:
        more = count > 1
        begin, count = begin[more], count[more]
        if not len(begin):
            break
        # The first row of each value with all others that hold it.
        reach = count - 1
        starts = np.repeat(begin, reach)
        step = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach) + 1
        a, b = rows[starts], rows[starts + step]
        np.add.at(common, (a, b), 1)
        np.add.at(common, (b, a), 1)
        begin, count = begin + 1, count - 1
    return common
