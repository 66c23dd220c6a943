"""Repeated stretches against a plain look at every string."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlink.llm import spans
from rosterlink.llm.queries import QUERIES, table

COLUMNS = "doc_id n_bytes n_removed n_spans kept_sha256".split()


def expected(rows, length=100):
    """Rows in order of ids, those without one last."""
    seen, made = set(), []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            own = raw[p : p + length]
            if own in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(own)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        n_spans = sum(g and not before for g, before in zip(gone, b"\0" + gone, strict=False))
        made.append((doc_id, len(raw), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return made


def listed(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents").select("doc_id", "text").collect()
    want = expected(sorted((r.doc_id, r.text) for r in docs))
    assert sum(w[2] for w in want) > 0
    assert listed(QUERIES["op12_repeated_spans"](spark, folder)) == sorted(want, key=repr)


def odd_rows():
    r = random.Random(4)

    def prose(n):
        return " ".join("".join(r.choices("abcdeé漢", k=r.randint(2, 9))) for _ in range(n))

    passage, long = prose(60), prose(4000)
    rows = [(i, prose(r.randint(1, 40)) + passage + prose(r.randint(1, 40))) for i in range(60)]
    rows += [(100 + i, long) for i in range(20)]
    rows += [(200, "x" * 99), (201, "x" * 100), (202, "x" * 1000), (203, "ab" * 700), (204, "abc" * 50 + "ab" * 80)]
    rows += [(210, None), (211, ""), (212, passage[:50] + long[5000:7000] + passage[-80:] * 2)]
    rows += [(220 + i, long[r.randrange(9000) :][: r.randint(50, 500)]) for i in range(40)]
    return rows


SCHEMA = "doc_id long, text string, row string, doc int, runs int, key string"


@pytest.mark.parametrize("chunk, most, unit", [(2**21, 4096, 2**20), (700, 4096, 500), (700, 3, 500), (2**21, 2, 2**20)])
def test_odd_texts(spark, chunk, most, unit):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA).repartition(5)
    assert listed(spans.without_repeats(docs, most=most, chunk=chunk, unit=unit)) == sorted(expected(rows), key=repr)


def test_rows_without_an_id_come_last_and_no_rows(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=300))
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (3, text[:150]), (None, text)], "doc_id long, text string").coalesce(1)
    made = listed(spans.without_repeats(docs))
    order = [(3, text[:150]), (7, text), (7, text), (None, text), (None, text)]
    assert made == sorted(expected(order), key=repr)
    assert spans.without_repeats(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=60), st.integers(1, 12))
def test_common_prefixes(text, length):
    data = np.frombuffer(text.encode() + b"\0", dtype=np.uint8).astype(np.uint16)
    places = spans.suffix_order(data, length + 1)
    rolled = [bytes(np.roll(data, -p).astype(np.uint8)) for p in places]
    assert [x[: length + 1] for x in rolled] == sorted(x[: length + 1] for x in rolled)
    shared = spans.common_prefixes(data[places - 1], length)
    for i in range(1, len(places)):
        n = 0
        while n < length and rolled[i][n] == rolled[i - 1][n]:
            n += 1
        assert shared[i] == (-1 if n == length else n)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=5, max_size=40), min_size=1, max_size=12), st.integers(0, 2**30))
def test_repeated_starts(strings, seed):
    strings = strings + [strings[0][:5] + strings[-1]]
    counts = np.array([len(s) - 4 for s in strings])
    order = np.random.default_rng(seed).permutation(len(strings))
    made = spans.repeated_starts(strings, counts, order, 5)
    seen, want = set(), [[] for _ in strings]
    for i in np.argsort(order):
        for p in range(counts[i]):
            own = strings[i][p : p + 5]
            want[i].append(own in seen)
            seen.add(own)
    assert made.tolist() == [x for w in want for x in w]
