"""Whitening against numpy's own eigendecomposition of the whole table."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlink.llm import whitening
from rosterlink.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.01"


def check_table(made, vectors):
    """``made`` rows against ``vectors``: a list of (id, entries)."""
    x = np.floor(np.array([v for _, v in vectors], dtype=float) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    values, turned = values[::-1], turned[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    wanted = min(8, int((values > 1e-9 * values[0]).sum()))
    assert len(made) == n * wanted
    at = {i: k for k, (i, _) in enumerate(vectors)}
    got = np.zeros((n, wanted))
    for r in made:
        k, c = at[r.vec_id], r.component - 1
        got[k, c] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[k])
        assert abs(r.explained * values.sum() / values[c] - 1) < 1e-9
        assert r.identity_error < 1e-9
    plain = centred @ turned[:, :wanted] / np.sqrt(values[:wanted])
    signs = np.sign((got * plain).sum(axis=0))
    assert np.abs(got - plain * signs).max() < 1e-7
    assert np.abs(got.T @ got / n - np.eye(wanted)).max() < 1e-9


def test_registered_query(spark):
    vectors = [(r.vec_id, r.embedding) for r in table(spark, FOLDER, "embeddings").collect()]
    check_table(QUERIES["op13_whitening"](spark, FOLDER).collect(), vectors)


def test_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = table(spark, FOLDER, "embeddings").limit(300).repartition(7).cache()
    vectors = [(r.vec_id, r.embedding) for r in rows.collect()]
    check_table(whitening.whiten(rows).collect(), vectors)


@settings(max_examples=150, deadline=None)
@given(
    st.integers(1, 12),
    st.lists(st.sampled_from(["random", "zero", "axis", "repeat", "tiny"]), min_size=1, max_size=30),
    st.integers(0, 2**31),
)
def test_rank_one_updates_keep_the_decomposition(size, kinds, seed):
    random = np.random.default_rng(seed)
    values, vectors, plain = np.zeros(size), np.eye(size), np.zeros((size, size))
    last = random.normal(size=size)
    for kind in kinds:
        update = random.normal(size=size) * 10.0 ** random.integers(-3, 4)
        if kind == "zero":
            update = np.zeros(size)
        elif kind == "axis":
            update = np.eye(size)[random.integers(size)]
        elif kind == "repeat":
            update = last
        elif kind == "tiny":
            update = update * 1e-12
        last, rho = update, float(random.uniform(0, 5))
        values, vectors = whitening.rank_one(values, vectors, update, rho)
        plain += rho * np.outer(update, update)
    scale = max(np.abs(plain).max(), 1e-300)
    assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-12
    assert np.abs((vectors * values) @ vectors.T - plain).max() < 1e-12 * scale
    assert (np.diff(values) >= 0).all()


def test_combined_spectra_equal_one(spark):
    random = np.random.default_rng(5)
    x = (random.normal(size=(90, 6)) * [1, 3, 5, 0, 100, 2]).round().astype(np.int64)
    whole = whitening.Spectrum(6)
    for rows in (x[:20], x[20:21], x[21:21], x[21:]):
        own = whitening.Spectrum(6)
        for row in rows:
            own.add(row)
        whole.combine(own)
    centred = x - x.mean(axis=0)
    assert (whole.n, whole.sums.tolist()) == (90, x.sum(axis=0).tolist())
    assert np.allclose((whole.vectors * whole.values) @ whole.vectors.T, centred.T @ centred, atol=1e-8)
    weighted = whitening.Spectrum(6)
    weighted.add(x[0], 3)
    weighted.add(x[1], 2)
    five = x[[0, 0, 0, 1, 1]] - x[[0, 0, 0, 1, 1]].mean(axis=0)
    assert np.allclose((weighted.vectors * weighted.values) @ weighted.vectors.T, five.T @ five, atol=1e-8)


def test_odd_rows(spark):
    random = np.random.default_rng(3)
    good = [(i % 5 if i < 10 else None, random.normal(size=3).tolist()) for i in range(20)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan"), 1.0, 1.0]), (93, [float("inf"), 0.0, 1.0]), (94, []), (95, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, n string, component int, id string"
    rows = spark.createDataFrame([(i, v, "a", 4, "b") for i, v in good + bad], schema).repartition(3)
    made = whitening.whiten(rows).collect()
    assert len(made) == 60 and {r.n for r in made} == {20}
    assert sorted({r.vec_id for r in made if r.vec_id is not None}) == [0, 1, 2, 3, 4]
    assert made[0].identity_error < 1e-12
    assert whitening.whiten(rows.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [0.25, 0.5]) for i in range(4)], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    far = whitening.whiten(huge).collect()
    assert {r.component for r in far} >= {1} and all(r.deviation is None or r.deviation > 0 for r in far)


@pytest.mark.parametrize("size", [2, 30])
def test_roots_of_close_poles(size):
    poles = np.cumsum(np.full(size, 1e-9)) + 1
    weights = np.full(size, 1 / np.sqrt(size))
    roots, gaps = whitening.secular_roots(poles, weights, 2.0)
    plain = np.linalg.eigvalsh(np.diag(poles) + 2 * np.outer(weights, weights))
    assert np.abs(roots - plain).max() < 1e-13 and (roots[:-1] < poles[1:]).all() and (roots > poles).all()
