"""Near-duplicate embeddings against all pairs, and the lattice decoder."""

import math

import numpy as np
import pytest

from rosterlink.llm import components, lattice


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def expected(rows, cosine=0.93):
    units = []
    for i, v, label in rows:
        ok = i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v)
        a = np.array(v, dtype=np.float64) if ok and any(v) else None
        units.append(None if a is None else a / np.linalg.norm(a))
    parent = {i: i for i, *_ in rows if i is not None}
    links = [0] * len(rows)
    for a, (i, _, la) in enumerate(rows):
        for b, (j, _, lb) in enumerate(rows[:a]):
            u, v = units[a], units[b]
            if u is None or v is None or la != lb or len(u) != len(v) or u @ v < cosine:
                continue
            links[a] += 1
            links[b] += 1
            x, y = find(parent, i), find(parent, j)
            parent[max(x, y)] = min(x, y)
    return sorted(
        (i is None, i or 0, links[k], i is None, 0 if i is None else find(parent, i) if units[k] is not None else i)
        for k, (i, *_) in enumerate(rows)
    )


def vectors(n, dimensions=64):
    r = np.random.default_rng(5)
    made = []
    for k in range(n):
        a = r.normal(size=dimensions)
        a /= np.linalg.norm(a)
        made.append(a)
        for c in (0.9, 0.925, 0.935, 0.95, 0.99):
            b = r.normal(size=dimensions)
            b -= (b @ a) * a
            made.append(c * a + math.sqrt(1 - c * c) * b / np.linalg.norm(b))
        made += [a * 3] if k % 5 == 0 else []
    return made


@pytest.fixture(scope="module")
def rows():
    made = [(i * 2, v.astype(np.float32).tolist(), i // 200) for i, v in enumerate(vectors(80))]
    clique = np.random.default_rng(6).normal(size=64)
    noise = np.random.default_rng(7).normal(size=(60, 64)) * 0.05
    made += [(5001 + i, (clique + e).astype(np.float32).tolist(), 0) for i, e in enumerate(noise)]
    same = made[0][1]
    made += [(1, same, 0), (3, same, 0), (3, same, 0), (5, same, 1), (7, same, None), (None, same, 0)]
    made += [(9001, None, 0), (9003, [0.0] * 64, 0), (9005, [None, *same[1:]], 0), (9007, [], 0)]
    made += [(9009, [float("nan"), *same[1:]], 0), (9011, [float("inf"), *same[1:]], 0)]
    made += [(9013, [1.0, 0.5], 0), (9015, [1.0, 0.5001], 0), (9017, [1e-30, 2e-30], 0), (9019, [1e30, 2e30], 0)]
    return made


@pytest.mark.parametrize("block", [1024, 10])
def test_against_all_pairs(spark, rows, block, monkeypatch):
    monkeypatch.setattr(lattice, "VECTORS_PER_BLOCK", block)
    data = spark.createDataFrame(
        [(i, v, label, 1, 2) for i, v, label in rows],
        "vec_id long, embedding array<float>, label int, cell int, first int",
    ).repartition(4)
    made = lattice.near_duplicates(data).collect()
    got = sorted(
        (r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id is None, r.component_id or 0) for r in made
    )
    assert got == expected([(i, v, label) for i, v, label in rows])
    assert all(r.kept == (r.vec_id == r.component_id) for r in made)


def test_no_rows(spark):
    data = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in lattice.near_duplicates(data).collect()] == [(1, 0, 1, True)]
    assert lattice.near_duplicates(data.limit(0)).count() == 0


def test_decoder_finds_the_nearest_point():
    near = lattice.minimal_vectors()
    assert len(np.unique(near, axis=0)) == 240 and np.allclose((near**2).sum(axis=1), 2)
    x = np.random.default_rng(2).normal(size=(500, 8)) * 3
    point = lattice.decode(x)
    twice = point * 2
    assert (np.all(twice % 2 == 0, axis=1) | np.all(twice % 2 == 1, axis=1)).all()
    assert (point.sum(axis=1) % 2 == 0).all()
    own = ((x - point) ** 2).sum(axis=1)
    # No neighbour of the point is nearer, and E8's Voronoi cells touch only neighbours
    # at distances of the square roots of 2 and 4.
    longer = (near[:, None] + near[None]).reshape(-1, 8)
    for other in (near, longer[np.isclose((longer**2).sum(axis=1), 4)]):
        assert (((x[:, None] - point[:, None] - other[None]) ** 2).sum(axis=2).min(axis=1) >= own - 1e-9).all()


def test_recall_at_the_limit():
    r = np.random.default_rng(9)
    a = r.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = r.normal(size=(3000, 64))
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1)[:, None]
    args = lattice.TABLES, lattice.PROBES, lattice.SCALE, lattice.SEED
    x, y = lattice.cells_of(a, *args), lattice.cells_of(b, *args)
    assert (x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).mean() > 0.999


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7), (None, 3), (300, 299)]
    made = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert made == {
        **dict.fromkeys(range(100, 161), 100), 5: 5, **dict.fromkeys(range(200, 260), 5), 299: 299, 300: 299
    }
