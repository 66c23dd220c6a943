"""Near-duplicate embeddings by lattice hashing.

A vector is scaled to length one and projected to eight dimensions by random
orthonormal directions, once per table. The projection is decoded to the nearest point
of the E8 lattice; the point is the vector's cell. A vector is also entered under the
neighbouring cells that lie nearest to its projection (probing). Vectors that meet in
some cell of some table are compared in double precision. Only vectors with equal labels meet.

With the defaults a pair at the limit (cosine 0.93) meets in one table with
probability 0.949, so that all four miss it once in 150,000 pairs; closer pairs are
missed far less.

A pair that meets in several cells is counted in the first of them alone: both
vectors carry the list of their cells, so no table of pairs is needed to tell.
Equal vectors form a class of which one stands for all. A cell's vectors are
compared in blocks (``groups.py``); a block's work returns counts of links per vector
and a spanning forest of the links, not the pairs.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.durable import stored

from .components import with_components
from .groups import block_pairs, forest, per_unit, shared_values

COSINE = 0.93
TABLES = 4
PROBES = 4
# Length of a projected unit vector's space in lattice units: larger means smaller cells.
SCALE = 5.0
SEED = 8

VECTORS_PER_BLOCK = 1024
ROWS_AT_ONCE = 1000

_ENTERED = "rep long, label int, vector binary, cells array<long>"
_COMPARED = "a long, b long, n_links long"


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: neighbours of the origin."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    halves = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    return np.concatenate([found, halves[(halves < 0).sum(axis=1) % 2 == 0]])


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of an even sum (D8), row by row."""
    point = np.rint(x)
    rest = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    worst = np.abs(rest[odd]).argmax(axis=1)
    point[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return point


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8: D8, or D8 moved by one half in every coordinate."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


@functools.lru_cache(maxsize=8)
def directions(dimensions: int, tables: int, seed: int) -> list[np.ndarray]:
    """Eight orthonormal directions per table (fewer if the vectors have fewer dimensions)."""
    random = np.random.default_rng([seed, dimensions])
    made = []
    for _ in range(tables):
        q = np.linalg.qr(random.normal(size=(dimensions, min(8, dimensions))))[0]
        made.append(np.pad(q, ((0, 0), (0, 8 - q.shape[1]))))
    return made


def cells_of(units: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Hashes of each unit vector's cells: ``probes + 1`` for each table."""
    near = minimal_vectors()
    weights = np.random.default_rng(seed).integers(1, 2**62, 8, dtype=np.int64) | 1
    made = []
    # Short vectors need more stretching for the same distances.
    stretch = scale * np.sqrt(units.shape[1] / 64)
    for table, q in enumerate(directions(units.shape[1], tables, seed)):
        x = units @ q * stretch
        point = decode(x)
        order = np.argsort(-((x - point) @ near.T), axis=1, kind="stable")[:, :probes]
        points = np.concatenate([point[:, None], point[:, None] + near[order]], axis=1)
        hashed = ((points * 2).astype(np.int64) * weights).sum(axis=2) + (table + 1) * weights[::-1].sum()
        hashed ^= hashed >> 31
        made.append(hashed * np.int64(0x5851F42D4C957F2D))
    return np.concatenate(made, axis=1)


def entered(
    vectors: DataFrame, tables: int, probes: int, scale: float, seed: int
) -> DataFrame:
    """``rep``, ``label``, the unit vector, and its cells; unusable vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                rows = [np.array(x.as_py(), dtype=np.float64) for x in batch.column(2)]
                largest = np.array([np.abs(r).max(initial=0) for r in rows])
                for size in {len(r) for r in rows}:
                    at = [i for i, r in enumerate(rows) if len(r) == size and largest[i] > 0]
                    if not at:
                        continue
                    units = np.stack([rows[i] / largest[i] for i in at])
                    units /= np.linalg.norm(units, axis=1)[:, None]
                    cells = cells_of(units, tables, probes, scale, seed)
                    columns = [
                        batch.column(0).take(pa.array(at)),
                        batch.column(1).take(pa.array(at)),
                        pa.array([u.tobytes() for u in units], pa.binary()),
                        pa.array(list(cells), pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["rep", "label", "vector", "cells"])

    return vectors.select("rep", "label", "embedding").mapInArrow(run, _ENTERED)


def _compared(cosine: float):
    def work(unit: pa.Table) -> pa.Table | None:
        by_size: dict[int, list[int]] = {}
        held = [x.as_py() for x in unit["vector"]]
        for i, x in enumerate(held):
            by_size.setdefault(len(x), []).append(i)
        made = [
            t
            for at in by_size.values()
            if len(at) > 1 and (t := _links(unit.take(pa.array(at)), [held[i] for i in at]))
        ]
        return pa.concat_tables(made) if made else None

    def _links(unit: pa.Table, held: list[bytes]) -> pa.Table | None:
        units = np.frombuffer(b"".join(held), dtype=np.float64).reshape(len(held), -1)
        ok = np.triu(units @ units.T >= cosine, 1)
        if unit["lower"][0] != unit["upper"][0]:
            own = unit["own"].to_numpy()
            ok &= own[:, None] != own[None, :]
        if not ok.any():
            return None
        # Leave out pairs that also meet in a cell before this one.
        cell = unit["cell"][0].as_py()
        lists = unit["cells"].combine_chunks()
        values = lists.flatten().to_numpy()
        rows = np.repeat(np.arange(len(held)), lists.value_lengths().to_numpy())
        before = values < cell
        if before.any():
            pairs = np.unique(np.stack([values[before], rows[before]]), axis=1)
            ok &= shared_values(pairs[0], pairs[1], len(held)) == 0
        left, right = np.nonzero(ok)
        if not len(left):
            return None
        ids, copies = unit["rep"].to_numpy(), unit["copies"].to_numpy()
        counts = np.zeros(len(ids), dtype=np.int64)
        np.add.at(counts, left, copies[right])
        np.add.at(counts, right, copies[left])
        root = forest(len(ids), left, right)
        linked = np.flatnonzero(counts)
        return pa.table({"a": ids[linked], "b": ids[root[linked]], "n_links": counts[linked]})

    return work


def near_duplicates(
    embeddings: DataFrame,
    cosine: float = COSINE,
    tables: int = TABLES,
    probes: int = PROBES,
    scale: float = SCALE,
    seed: int = SEED,
    id_column: str = "vec_id",
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Vectors link if their labels are equal and not null and their cosine is at least
    ``cosine``. ``n_links`` counts the other rows that a row is linked with,
    ``component_id`` is the smallest id reachable, ``kept`` says whether it is the own id. A
    vector that is null or zero, or holds null or non-finite components, links with
    nothing, as do vectors of different lengths. Rows that share an id count each by
    themselves, but are one node as to reaching. A row without an id links with
    nothing, has a null component and is kept. Extra columns are ignored; no rows give an empty table.
    """
    vector = F.col("embedding")
    sound = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = (
        F.col(id_column).isNotNull()
        & F.col("label").isNotNull()
        & sound
        & F.exists(vector, lambda x: x != 0)
    )
    rows = embeddings.select(
        F.col(id_column).cast("long").alias("id"),
        F.col("label").cast("int").alias("label"),
        F.when(usable, F.xxhash64(vector)).alias("key_low"),
        F.when(usable, F.xxhash64(F.lit(seed), vector)).alias("key_high"),
        vector.alias("embedding"),
    )
    keys = ["label", "key_low", "key_high"]
    # Equal vectors with equal labels: a class with a number of its own.
    classes = stored(
        rows.filter("key_low is not null")
        .groupBy(*keys)
        .agg(
            F.min("id").alias("first"),
            F.count("*").alias("copies"),
            F.first("embedding").alias("embedding"),
        )
        .withColumn("rep", F.monotonically_increasing_id())
    )
    table = stored(
        entered(classes, tables, probes, scale, seed).join(classes.select("rep", "copies"), "rep")
    )
    places = table.select("label", F.explode(F.array_distinct("cells")).alias("cell"), "rep")
    units = block_pairs(places, ["label", "cell"], "rep", F.lit(1), VECTORS_PER_BLOCK)
    members = units.join(table.drop("label"), "rep")
    found = stored(per_unit(members, ["label", "cell"], _compared(cosine), _COMPARED))

    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n_links").alias("n"))
    linked = stored(
        classes.join(counts, "rep", "left").select(
            "rep", *keys, "first", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
        )
    )
    ids = linked.select("rep", "first")
    links = (
        found.select("a", "b")
        .filter("a != b")
        .distinct()
        .join(ids.toDF("a", "x"), "a")
        .join(ids.toDF("b", "y"), "b")
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
    )
    members = rows.drop("embedding").join(linked.drop("rep"), keys, "left")
    return with_components(members, links).select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )
