"""Near-duplicate documents against all pairs of full sets."""

import random
import re

import numpy as np
import pytest

from rosterlink.llm import groups, shingles, sketches


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def expected(rows, percent=85):
    """Components by id; rows without id or text link with nothing."""
    usable = [(i, grams(t)) for i, t in rows if i is not None and grams(t)]
    parent = {i: i for i, _ in rows if i is not None}
    for a in range(len(usable)):
        for b in range(a):
            (i, s), (j, t) = usable[a], usable[b]
            n = len(s & t)
            if 100 * n >= percent * (len(s) + len(t) - n):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    made = []
    for i, t in rows:
        component = None if i is None else find(parent, i) if grams(t) else i
        made.append((i is None, i or 0, len(grams(t)), component is None, component or 0, i == component))
    return sorted(made)


def made_of(df):
    return sorted(
        (r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id is None, r.component_id or 0, r.kept)
        for r in df.collect()
    )


def edited(random_, words, n):
    words = list(words)
    for _ in range(n):
        words[random_.randrange(len(words))] = f"new{random_.randrange(10**9)}"
    return words


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=60)
    texts = [None, "", " \n", "one", "ONE", "one two", "one two three four five", "One two three four five"]
    for _ in range(40):
        texts.append(" ".join(r.choices(vocabulary, k=r.randrange(5, 200)) + passage))
    base = r.choices(vocabulary, k=150)
    texts += [" ".join(base)] * 20 + [" ".join(edited(r, base, r.randrange(0, 8))) for _ in range(120)]
    for n in range(1, 30):
        short = r.choices(vocabulary, k=n)
        texts += [" ".join(short), " ".join(edited(r, short, 1)), " ".join([*short, "end"])]
    long = r.choices(vocabulary, k=30000)
    texts += [" ".join(long), " ".join(edited(r, long, 200)), "x" * 200000]
    r.shuffle(texts)
    made = [(i + 10, t) for i, t in enumerate(texts)]
    # Repeated rows, an id with two texts, and texts without an id.
    return [*made, made[50], (made[60][0], made[200][1]), (None, " ".join(base)), (None, None)]


@pytest.mark.parametrize("block", [1024, 16])
def test_against_all_pairs(spark, rows, block, monkeypatch):
    monkeypatch.setattr(sketches, "DOCS_PER_BLOCK", block)
    monkeypatch.setattr(sketches, "BYTES_PER_BLOCK", block * 4096)
    docs = spark.createDataFrame(
        [(i, t, 1, 2, "c") for i, t in rows],
        "doc_id long, text string, cluster int, n_shingles int, first string",
    ).repartition(5)
    assert made_of(sketches.near_duplicates(docs)) == expected(rows)


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert made_of(sketches.near_duplicates(docs)) == expected([(1, None), (2, "")])
    assert sketches.near_duplicates(docs.limit(0)).count() == 0


def test_shingle_hashes_name_the_sets():
    texts = ["", "a", "A", "b a", "a b", "a b c d e", "a b c d e f", "é ß\x0bç d e ", "a b c d e a b c d e", "x" * 3_000_000]
    made = shingles.shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in made] == [len(grams(t)) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert (made[i].tobytes() == made[j].tobytes()) == (grams(texts[i]) == grams(texts[j]))


def test_shared_values_and_forest():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 30))) for _ in range(90)]
    values = np.concatenate(sets)
    rows = np.repeat(np.arange(90), [len(s) for s in sets])
    made = groups.shared_values(values, rows, 90)
    for i in range(90):
        for j in range(90):
            if i != j:
                assert made[i, j] == len(np.intersect1d(sets[i], sets[j]))
    left, right = r.integers(0, 200, 120), r.integers(0, 200, 120)
    root = groups.forest(200, left, right)
    parent = list(range(200))
    for a, b in zip(left, right, strict=True):
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    assert root.tolist() == [find(parent, i) for i in range(200)]


def test_bounds_follow_the_limit():
    assert [sketches.least_shared(p) for p in (80, 85)] == [4, 5]
    assert [sketches.margin(p) for p in (80, 85)] == [0.24, 0.21]
    for p in (80, 85):
        made = np.random.default_rng(1).binomial(sketches.LISTED, p / 100, 10**6)
        assert (made < sketches.least_shared(p)).sum() <= 5


@pytest.mark.parametrize("size", [32, 64, 512, 1024, 2048, 4096, 65536])
def test_long_regular_words_have_hashes_of_their_own(size):
    """Two letters in Thue-Morse order and the same exchanged, for which sums of powers modulo 2^64 agree."""
    one = bytes(b"ab"[bin(i).count("1") % 2] for i in range(size))
    other = one.translate(bytes.maketrans(b"ab", b"ba"))
    for around in (b"%s", b"%s and", b"w " * 6 + b"%s" + b" w" * 6):
        a, b, c = shingles.shingle_sets([around % one, around % other, around % one.upper()])
        assert len(a) == len(grams((around % one).decode())) and a.tolist() == c.tolist()
        assert not np.array_equal(a, b)
