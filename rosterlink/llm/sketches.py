"""Near-duplicate documents by bottom-k sketches.

1. A document's set is that of its word shingles (``shingles.py``). Its sketch is the
   ``KEPT`` smallest hashes of one hash function. Documents with equal sets form
   a class at once; one of them stands for it from here on.
2. Inverted lists: each of a sketch's ``LISTED`` smallest values leads to the documents
   that retain it. Two documents that are similar enough share most of them, at
   least ``least_shared`` but for a chance below one in a million (a binomial tail). So
   the lists of a document's most frequent values can be passed over: if two documents
   share so many values, one of these is among the rarest of both (all but ``least_shared - 1``).
   Passages that very many documents share thus make no long lists, unless
   a document consists of little else.
3. Inside a list, pairs are filtered by the union of their sketches: the values
   up to the lower of both sketches' ends are a uniform sample of the union, and the share
   that both retain estimates the similarity. A pair goes on when its estimate is
   above the limit less ``margin``. Only a spanning forest of such pairs leaves a task.
4. The forest's components hold all documents that can be linked. The full sets of
   these documents, and of no others, are made again from the texts; inside each component all
   pairs are compared exactly. Again a spanning forest of the links leaves a task.
5. Components of the links between classes give the answer.

Lists and components of any size are compared in blocks (``groups.py``): no group is
gathered in one task, none is cut off, and no table holds a row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.durable import stored

from .components import components, with_components
from .groups import block_pairs, forest, per_unit, shared_values
from .shingles import shingle_sets

# Links have 100 * intersection >= PERCENT * union, where no other limit is asked for.
PERCENT = 85
KEPT = 48
LISTED = 16
# Documents, and bytes of sets, in a block.
DOCS_PER_BLOCK = 1024
BYTES_PER_BLOCK = 4 * 2**20

ROWS_AT_ONCE = 1000

_SKETCH = "doc_id long, n_shingles long, set_low long, set_high long, sketch binary"
_LINKS = "a long, b long"


def least_shared(percent: int) -> int:
    """How many listed values two documents at the limit share, but for a chance of 1e-6."""
    p, tail, n = percent / 100, 0.0, 0
    while n < LISTED:
        tail += math.comb(LISTED, n) * p**n * (1 - p) ** (LISTED - n)
        if tail >= 1e-6:
            break
        n += 1
    return max(1, n)


def margin(percent: int) -> float:
    """Four standard deviations of the estimate at the limit, in whole hundredths."""
    p = percent / 100
    return math.ceil(400 * math.sqrt(p * (1 - p) / KEPT)) / 100


def sketched(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_shingles``, two halves of a checksum of the set, ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                sets = shingle_sets([(x.as_py() or "").encode() for x in batch.column(1)])
                sums = [_checksum(s) for s in sets]
                columns = [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([a for a, _ in sums], pa.int64()),
                    pa.array([b for _, b in sums], pa.int64()),
                    pa.array([s[:KEPT].tobytes() for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "n_shingles", "set_low", "set_high", "sketch"]
                )

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text"))
    return narrow.mapInArrow(run, _SKETCH)


def _checksum(values: np.ndarray) -> tuple[int, int]:
    """Two sums of differently mixed values: sets are equal if both are."""
    one = values * np.uint64(0x9E3779B97F4A7C15)
    one ^= one >> np.uint64(29)
    two = values * np.uint64(0xC2B2AE3D27D4EB4F)
    two ^= two >> np.uint64(31)
    return tuple(int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (one * one, two * two))


def full_sets(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``cluster``, ``n_shingles`` and ``set`` of the given documents' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                sets = shingle_sets([(x.as_py() or "").encode() for x in batch.column(2)])
                columns = [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "cluster", "n_shingles", "set"]
                )

    schema = "doc_id long, cluster long, n_shingles long, set binary"
    return docs.select("doc_id", "cluster", "text").mapInArrow(run, schema)


def listed(representatives: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``value``, ``doc_id``: the lists that a document takes part in."""
    least = least_shared(percent)
    value = F.transform(
        F.sequence(F.lit(0), F.least(F.lit(LISTED), F.col("n_shingles").cast("int")) - 1),
        lambda i: F.hex(F.substring("sketch", i * 8 + 1, F.lit(8))),
    )
    postings = representatives.select("doc_id", F.explode(value).alias("value"))
    frequent = postings.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    counted = postings.join(frequent, "value", "left").select(
        "doc_id", F.struct(F.coalesce("n", F.lit(1)).alias("n"), "value").alias("own")
    )
    size = F.size("owns")
    shared = F.greatest(F.lit(1), F.least(F.lit(least), F.floor(size * least / LISTED)))
    by_doc = counted.groupBy("doc_id").agg(F.sort_array(F.collect_list("own")).alias("owns"))
    rarest = F.filter(
        F.slice("owns", 1, (size - shared + 1).cast("int")), lambda x: x["n"] > 1
    )
    return by_doc.select("doc_id", F.explode(rarest).alias("own")).select(
        F.col("own.value").alias("value"), "doc_id"
    )


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of binary sets, and the row of each."""
    sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in column]
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return np.concatenate(sets), rows


def _edges(ids: np.ndarray, ok: np.ndarray) -> pa.Table | None:
    """A spanning forest of the pairs that a matrix marks."""
    left, right = np.nonzero(np.triu(ok, 1))
    if not len(left):
        return None
    root = forest(len(ids), left, right)
    hung = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"a": ids[hung], "b": ids[root[hung]]})


def _crossing(unit: pa.Table) -> np.ndarray | bool:
    """Which pairs are this unit's work: all in one block, or those across two."""
    if unit["lower"][0] == unit["upper"][0]:
        return True
    own = unit["own"].to_numpy()
    return own[:, None] != own[None, :]


def _estimated(percent: int, less: float):
    def work(unit: pa.Table) -> pa.Table | None:
        n, sizes = unit.num_rows, unit["n_shingles"].to_numpy()
        values, rows = _ragged(unit["sketch"])
        both = shared_values(values, rows, n)
        counts = np.minimum(sizes, KEPT)
        borders = np.cumsum(counts)
        last = values[borders - 1].copy()
        last[sizes <= KEPT] = np.uint64(2**64 - 1)
        # Values of each row's sketch up to every row's end.
        upto = np.empty((n, n), dtype=np.float32)
        for i, (a, b) in enumerate(zip(borders - counts, borders, strict=True)):
            upto[i] = np.searchsorted(values[a:b], last, side="right")
        union = upto + upto.T - both
        lowest, highest = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
        limit = percent / 100 - less
        ok = (both >= limit * union) & (100 * lowest >= percent * highest) & (both > 0)
        return _edges(unit["doc_id"].to_numpy(), ok & _crossing(unit))

    return work


def _exact(percent: int):
    def work(unit: pa.Table) -> pa.Table | None:
        n, sizes = unit.num_rows, unit["n_shingles"].to_numpy()
        values, rows = _ragged(unit["set"])
        both = shared_values(values, rows, n).astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - both
        ok = (100 * both >= percent * union) & (both > 0)
        return _edges(unit["doc_id"].to_numpy(), ok & _crossing(unit))

    return work


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    id_column: str = "doc_id",
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    ``component_id`` is the smallest id reachable by links of at least ``percent``
    similarity, itself included; ``kept`` says whether it is the own id. Null and
    empty texts have no shingles and link with nothing. Rows that share an id are one
    document as to links, and each has its row. A row without an id links with
    nothing, has a null component and is kept. Extra columns are ignored; no rows give
    an empty table.
    """
    table = stored(sketched(docs, id_column))
    keys = ["n_shingles", "set_low", "set_high"]
    # One row stands for each class of equal sets; an id may stand for several.
    representatives = stored(
        table.filter("n_shingles > 0 and doc_id is not null")
        .groupBy(*keys)
        .agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"))
    )
    postings = stored(listed(representatives, percent))
    lists = block_pairs(postings, ["value"], "doc_id", F.lit(1), DOCS_PER_BLOCK)
    members = lists.join(representatives.select("doc_id", "n_shingles", "sketch"), "doc_id")
    candidates = per_unit(members, ["value"], _estimated(percent, margin(percent)), _LINKS)
    clusters = components(candidates).withColumnRenamed("component", "cluster")

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text"))
    # Texts are shuffled whatever the number of candidates. Where the scan is large and the
    # candidates few, Spark puts a Bloom filter of their ids before the shuffle.
    wanted = clusters.withColumnRenamed("id", "doc_id").hint("merge")
    sets = full_sets(texts.join(wanted, "doc_id"))
    # A block is bounded in documents as well.
    size = F.greatest(F.col("n_shingles") * 8, F.lit(BYTES_PER_BLOCK // DOCS_PER_BLOCK))
    sized = clusters.withColumnRenamed("id", "doc_id").join(
        representatives.select("doc_id", "n_shingles"), "doc_id"
    )
    units = block_pairs(
        sets.filter("n_shingles > 0"), ["cluster"], "doc_id", size, BYTES_PER_BLOCK, sized
    )
    links = per_unit(units, ["cluster"], _exact(percent), _LINKS)
    first = F.when(F.col("id").isNotNull(), F.col("first"))
    members = (
        table.select(F.col("doc_id").alias("id"), *keys)
        .join(representatives.select(*keys, F.col("doc_id").alias("first")), keys, "left")
        .select("id", "n_shingles", first.alias("first"))
    )
    return with_components(members, links).select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )
