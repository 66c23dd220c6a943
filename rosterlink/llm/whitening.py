"""Whitening of embeddings by incremental eigendecomposition.

1. Each partition keeps its rows' count, mean, and the eigendecomposition of their scatter.
   A row is a centred rank-one update: with ``delta`` its distance from the mean so far, the
   scatter grows by ``n / (n + 1) * delta delta'``. In the basis of the eigenvectors this is a
   diagonal plus a rank-one matrix, whose eigenvalues are the roots of the secular equation.
   Directions that the update does not touch, and those of equal eigenvalues, are deflated
   first. Eigenvectors come from the weights that belong exactly to the roots found, so they
   stay orthogonal. Equal rows of a batch are one weighted update.
2. Two spectra are combined by as many rank-one updates as the smaller one has eigenvalues,
   and one more for the distance of the means. Spectra are small (one matrix of the dimensions) and
   are combined in a tree, ``FAN`` at a time, so that no task sees all partitions.
3. The leading eigenvectors, and ``GUARD`` more, are the basis of a Rayleigh-Ritz refinement:
   one pass multiplies the covariance, which is never stored, with the basis, and the small
   projected problem gives vectors and residuals. While a residual is above ``RESIDUAL``, the pass is
   repeated with the residuals in the basis.
4. One more pass measures the covariance of the whitened rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.durable import stored

COMPONENTS = 8
GUARD = 8
# Spectra that one task combines.
FAN = 8
# Passes of refinement at most, and the residual, as a share of the largest eigenvalue, that ends them.
PASSES = 6
RESIDUAL = 1e-13

# Entries become whole numbers of so many to one, moved up by ``SHIFT``.
SCALE, SHIFT = 1024.0, 100_000
# Beyond these bounds whole numbers stay at the bound, so that their sums are exact.
LOWEST, HIGHEST = -(2**31), 2**31

ROWS_AT_ONCE = 2000

_EPS = np.finfo(float).eps
_SPECTRUM = "part long, n long, sums binary, mean binary, values binary, vectors binary"
_OUT = (
    "id long, component int, n long, deviation long, whitened double, "
    "explained double, identity_error double"
)


def secular_roots(poles: np.ndarray, weights: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``diag(poles) + rho * weights weights'`` and all ``pole - eigenvalue``.

    Poles rise strictly, weights have length one, ``rho`` is positive. Each root is found as a
    distance from the nearer of the two poles around it, so differences keep their digits. Steps
    interpolate by two poles (by one beyond the last); a step that leaves the root's bracket is
    replaced by halving it.
    """
    m = len(poles)
    at = np.arange(m)
    upper = np.append(poles[1:], poles[-1] + rho)
    half = (upper - poles) / 2
    squares = weights * weights
    middle = 1 + rho * (squares[:, None] / (poles[:, None] - (poles + half)[None, :])).sum(axis=0)
    right = (middle < 0) & (at < m - 1)
    origin = np.where(right, upper, poles)
    low = np.where(right, -half, 0.0)
    high = np.where(right, 0.0, half)
    high[-1] = 2 * half[-1]
    if middle[-1] < 0:
        low[-1] = half[-1]
    distance = poles[:, None] - origin[None, :]
    tau = (low + high) / 2
    above = np.tril(np.ones((m, m), dtype=bool), -1)
    following = np.minimum(at + 1, m - 1)
    for _ in range(80):
        gaps = distance - tau
        terms = rho * squares[:, None] / gaps
        value = 1 + terms.sum(axis=0)
        done = np.abs(value) <= 4 * m * _EPS * (1 + np.abs(terms).sum(axis=0))
        if done.all():
            break
        slopes = terms / gaps
        slope, slope_above = slopes.sum(axis=0), (slopes * above).sum(axis=0)
        positive = value > 0
        high = np.where(positive, tau, high)
        low = np.where(positive, low, tau)
        first, second = gaps[at, at], gaps[following, at]
        a = (first + second) * value - first * second * slope
        b = first * second * value
        c = value - first * (slope - slope_above) - second * slope_above
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            weight = slope[-1] * first[-1] ** 2
            step[-1] = first[-1] + weight / (value[-1] - weight / first[-1])
        new = tau + step
        bad = ~(np.isfinite(new) & (new > low) & (new < high))
        new[bad] = (low[bad] + high[bad]) / 2
        tau = np.where(done, tau, new)
        if (np.abs(high - low) <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))).all():
            break
    return origin + tau, distance - tau


def rank_one(values: np.ndarray, vectors: np.ndarray, update: np.ndarray, rho: float):
    """Eigendecomposition of ``vectors diag(values) vectors' + rho * update update'``.

    Eigenvalues rise; eigenvectors are columns. ``rho`` is not negative.
    """
    z = vectors.T @ update
    length = float(z @ z)
    rho = rho * length
    if not rho > 0:
        return values, vectors
    z = z / np.sqrt(length)
    least = 8 * _EPS * max(float(np.abs(values).max()), rho)
    active = np.flatnonzero(rho * np.abs(z) > least)
    if not len(active):
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    a, b = active[:-1], active[1:]
    close = (values[b] - values[a]) * np.abs(z[a] * z[b]) <= least * (z[a] ** 2 + z[b] ** 2)
    if close.any():
        # Turn two directions of (nearly) equal eigenvalues so that the update misses one.
        kept, i = [], active[0]
        for j in active[1:]:
            t = np.hypot(z[i], z[j])
            c, s = z[j] / t, z[i] / t
            if (values[j] - values[i]) * abs(c * s) <= least:
                z[i], z[j] = 0.0, t
                turned = c * vectors[:, i] - s * vectors[:, j]
                vectors[:, j] = s * vectors[:, i] + c * vectors[:, j]
                vectors[:, i] = turned
                low, high = values[i], values[j]
                values[i], values[j] = low * c * c + high * s * s, low * s * s + high * c * c
            else:
                kept.append(i)
            i = j
        active = np.array([*kept, i])
        active = active[np.argsort(values[active], kind="stable")]
    z = z[active]
    z /= np.sqrt(z @ z)
    poles = values[active]
    roots, gaps = secular_roots(poles, z, rho)
    # Weights for which the roots are exact.
    m = len(poles)
    between = poles[None, :] - poles[:, None]
    below = np.concatenate([between[:, 1:], np.full((m, 1), rho)], axis=1)
    lower = np.tril(np.ones((m, m), dtype=bool), -1)
    exact = np.sqrt(np.abs(np.prod(-gaps / np.where(lower, between, below), axis=1)))
    columns = np.copysign(exact, z)[:, None] / gaps
    columns /= np.sqrt((columns * columns).sum(axis=0))
    vectors[:, active] = vectors[:, active] @ columns
    values[active] = roots
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, exact sums, mean and eigendecomposition of the scatter of whole-number rows."""

    def __init__(self, dimensions: int):
        self.n, self.sums = 0, np.zeros(dimensions, dtype=np.int64)
        self.mean = np.zeros(dimensions)
        self.values, self.vectors = np.zeros(dimensions), np.eye(dimensions)

    def add(self, row: np.ndarray, times: int = 1) -> None:
        self.sums += row * times
        if self.n:
            delta = row - self.mean
            weight = self.n * times / (self.n + times)
            self.values, self.vectors = rank_one(self.values, self.vectors, delta, weight)
            self.mean = self.mean + delta * (times / (self.n + times))
        else:
            self.mean = row.astype(float)
        self.n += times

    def combine(self, other: Spectrum) -> None:
        if not other.n:
            return
        if self.n:
            for value, vector in zip(other.values, other.vectors.T, strict=True):
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        else:
            self.values, self.vectors, self.mean = other.values, other.vectors, other.mean
        delta, total = other.mean - self.mean, self.n + other.n
        weight = self.n * other.n / total
        self.values, self.vectors = rank_one(self.values, self.vectors, delta, weight)
        self.mean = self.mean + delta * (other.n / total)
        self.n, self.sums = total, self.sums + other.sums

    def row(self, part: int) -> list:
        arrays = [self.sums, self.mean, self.values, self.vectors]
        return [part, self.n, *(np.ascontiguousarray(x).tobytes() for x in arrays)]

    @classmethod
    def of(cls, row) -> Spectrum:
        made = cls(len(row["mean"]) // 8)
        made.n, made.sums = int(row["n"]), np.frombuffer(row["sums"], dtype=np.int64)
        made.mean, made.values = np.frombuffer(row["mean"]), np.frombuffer(row["values"])
        made.vectors = np.frombuffer(row["vectors"]).reshape(len(made.mean), -1)
        return made


def whole_numbers(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    """Rows of whole numbers of a batch ``id, embedding`` of full vectors of one length."""
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * SCALE) + SHIFT
    return np.clip(scaled, LOWEST, HIGHEST).astype(np.int64).reshape(-1, dimensions)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(first, ROWS_AT_ONCE)


def spectra(rows: DataFrame, dimensions: int) -> DataFrame:
    """One spectrum for each partition that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(dimensions)
        for batch in _slices(batches):
            distinct, times = np.unique(whole_numbers(batch, dimensions), axis=0, return_counts=True)
            for row, n in zip(distinct, times.tolist(), strict=True):
                own.add(row, n)
        if own.n:
            row = own.row(TaskContext.get().partitionId())
            names = ["part", "n", "sums", "mean", "values", "vectors"]
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))])

    return rows.mapInArrow(run, _SPECTRUM)


def combined(found: DataFrame, parts: int) -> DataFrame:
    """All spectra in one, ``FAN`` at a time."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for _, row in group.sort_values("part").iterrows():
            if whole is None:
                whole = Spectrum.of(row)
            else:
                whole.combine(Spectrum.of(row))
        names = ["part", "n", "sums", "mean", "values", "vectors"]
        return pd.DataFrame([whole.row(int(key[0]))], columns=names)

    while parts > 1:
        found = found.groupBy(F.floor(F.col("part") / FAN).alias("part_")).applyInPandas(run, _SPECTRUM)
        parts = -(-parts // FAN)
    return found


def _summed(rows: DataFrame, size: int, work: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum over all rows of an array of ``size`` numbers that ``work`` makes from each batch.

    Partitions give one array each; arrays are added up in Spark, place by place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in _slices(batches):
            total += work(batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["place", "amount"]
        )

    sums = rows.mapInArrow(run, "place int, amount double").groupBy("place").agg(F.sum("amount").alias("amount"))
    made = np.zeros(size)
    for row in sums.collect():
        made[row["place"]] = row["amount"]
    return made


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Distances from the mean; exact before the division where 64 bits hold them."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    if n * most + int(np.abs(sums).max()) < 2**62:
        return (n * x - sums) / n
    return x - sums / n


def refined(
    rows: DataFrame, whole: Spectrum, components: int
) -> tuple[np.ndarray, np.ndarray, float]:
    """Leading eigenvalues and eigenvectors of the covariance, and its trace."""
    n, sums, dimensions = whole.n, whole.sums, len(whole.mean)
    basis = np.linalg.qr(whole.vectors[:, ::-1][:, : components + GUARD])[0]
    for _ in range(PASSES):
        width = basis.shape[1]

        def multiplied(batch: pa.RecordBatch, basis=basis) -> np.ndarray:
            x = _centred(whole_numbers(batch, dimensions), n, sums)
            return np.append((x.T @ (x @ basis)).ravel(), (x * x).sum())

        made = _summed(rows, dimensions * width + 1, multiplied) / n
        product, trace = made[:-1].reshape(dimensions, width), float(made[-1])
        projected = basis.T @ product
        values, turned = np.linalg.eigh((projected + projected.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        vectors, product = basis @ turned, product @ turned
        wanted = min(components, width)
        rest = (product - vectors * values)[:, :wanted]
        if np.sqrt((rest * rest).sum(axis=0)).max() <= RESIDUAL * max(values[0], 0):
            break
        leading = vectors[:, : components + GUARD]
        basis = np.linalg.qr(np.concatenate([leading, rest], axis=1))[0]
    return values[:wanted], vectors[:, :wanted], trace


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Exact sums of ``(n * x - sums) ** 2``; null where 64 bits do not hold one."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    bound = n * most + int(np.abs(sums).max())
    if bound < 2**62:
        distance = n * x - sums
        widest = int(np.abs(distance).max(initial=0))
        if len(sums) * widest * widest < 2**63:
            return pa.array((distance * distance).sum(axis=1))
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def usable(embeddings: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """``id``, ``embedding`` of the vectors that have entries, all of them finite."""
    vector = F.col("embedding")
    entry = F.element_at(vector, 1)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))
    return embeddings.filter(sound & entry.isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), vector.alias("embedding")
    )


def whiten(
    embeddings: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id"
) -> DataFrame:
    """One row per usable vector and leading component.

    Columns: the id, ``component`` (from 1, by falling eigenvalue), ``n`` (usable vectors),
    ``deviation`` (sum over dimensions of ``(n * x - sum) ** 2``, exact; null beyond 64 bits),
    ``whitened``, ``explained`` (eigenvalue by trace), ``identity_error`` (largest entry of the
    covariance of all whitened rows less the identity). An entry ``c`` counts as the whole
    number ``x = floor(1024 * c) + 100000``, kept within 32 bits and a sign.

    Vectors that are null or empty, or hold null or non-finite entries, are left out. All vectors
    must have one length: the most frequent one counts (of equally frequent ones the longest), others are left out.
    Components without variance are left out, so equal vectors give no rows. Rows that share an id or
    have none count each by themselves; extra columns are ignored; no rows give an empty table.
    """
    sound = stored(usable(embeddings, id_column))
    lengths = sound.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    empty = embeddings.sparkSession.createDataFrame([], _OUT).withColumnRenamed("id", id_column)
    if common is None:
        return empty
    dimensions = common["d"]
    rows = sound.filter(F.size("embedding") == dimensions)
    found = stored(spectra(rows, dimensions))
    parts = found.agg(F.max("part")).first()[0] + 1
    whole = Spectrum.of(combined(found, parts).first())
    values, vectors, trace = refined(rows, whole, components)
    n, sums = whole.n, whole.sums
    least = max(1e-12 * values[0], (1e-12 * float(np.abs(whole.mean).max())) ** 2)
    wanted = int((values > least).sum())
    if not wanted:
        return empty
    turn = vectors[:, :wanted] / np.sqrt(values[:wanted])
    explained = values[:wanted] / trace

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        y = _centred(whole_numbers(batch, dimensions), n, sums) @ turn
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    made = _summed(rows, wanted * (wanted + 1), moments) / n
    mean = made[wanted * wanted :]
    covariance = made[: wanted * wanted].reshape(wanted, wanted) - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(wanted)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = whole_numbers(batch, dimensions)
            y = _centred(x, n, sums) @ turn
            each = pa.array(np.repeat(np.arange(len(x)), wanted))
            size = len(each)
            columns = [
                batch.column(0).take(each),
                pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, n, dtype=np.int64)),
                _deviation(x, n, sums).take(each),
                pa.array(y.ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(size, error)),
            ]
            names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, _OUT).withColumnRenamed("id", id_column)
