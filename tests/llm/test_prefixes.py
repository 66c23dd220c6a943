"""Prefix encoding against the tiktoken library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlink.llm import prefixes
from rosterlink.llm.queries import PATTERN

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = prefixes.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = prefixes.encoder(PATH, PATTERN)
TEXT = st.text(st.one_of(st.sampled_from(" '\n\tsrtheaéß漢ан1"), st.characters(exclude_categories=["Cs"])))


def test_pattern_is_the_published_one():
    assert public_tokenizers.PATTERN == PATTERN


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_equals_library(text):
    ids = OWN.ids(text)
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=20))
def test_any_bytes_and_appending(first, more):
    table = OWN.pieces.extend(first, [])
    kept = list(table)
    whole = OWN.pieces.extend(first + more, table)
    assert whole[: len(first)] == kept
    assert OWN.pieces.tokens(first + more, whole) == prefixes.merged(RANKS, first + more)[0]


@settings(max_examples=200, deadline=None)
@given(st.text("abcetn ", min_size=1, max_size=40).map(str.encode), st.data())
def test_editing(piece, data):
    at = data.draw(st.integers(0, len(piece) - 1))
    table = OWN.pieces.extend(piece, [])
    edited = piece[:at] + b"X" + piece[at + 1 :]
    again = OWN.pieces.extend(edited, table[:at])
    assert OWN.pieces.tokens(edited, again) == prefixes.merged(RANKS, edited)[0]


def test_long_pieces():
    for text in ("a" * 20000, "ab" * 9000, "\n" * 3000 + "x", "é" * 5000):
        assert np.frombuffer(OWN.ids(text), "<u4").tolist() == LIBRARY.encode_ordinary(text)


def test_pieces_that_begin_alike_share_their_table(monkeypatch):
    """Only the bytes after the common beginning are searched for tokens."""
    own, searched = prefixes.PrefixEncoder(RANKS), []
    extend = own.extend
    monkeypatch.setattr(own, "extend", lambda text, last: searched.append(len(text) - len(last)) or extend(text, last))
    pieces = sorted(b"untranslatable" * 20 + str(i).encode() for i in range(100))
    made = own.ids(pieces)
    assert [own.decode(x) for x in made] == pieces
    assert made == [[RANKS[t] for t in prefixes.merged(RANKS, p)[0]] for p in pieces]
    assert sum(searched) < 280 + 200


def test_new_pieces_of_a_batch_are_sorted(monkeypatch):
    own, asked = prefixes.TextPrefixEncoder(PATH, PATTERN), []
    ids = own.pieces.ids
    monkeypatch.setattr(own.pieces, "ids", lambda pieces: asked.append(pieces) or ids(pieces))
    texts = ["zorkling abzug zorklong", "", "abzuge zorkling"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.batch(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert asked == [sorted({b"zorkling", b" abzug", b" zorklong", b"abzuge", b" zorkling"})]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(1, 30), st.integers(1, 50))
def test_small_bounds_give_the_same(texts, characters, pairs):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(prefixes, "CHARACTERS_AT_ONCE", characters)
        patch.setattr(prefixes, "MOST_PAIRS", pairs)
        ids = OWN.batch(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [LIBRARY.encode_ordinary(t) for t in texts]
        assert OWN.decode_batch(ids).to_pylist() == [t.encode() for t in texts]


def test_operator(spark):
    texts = [(1, "It's  a test\n\n x"), (1, None), (None, ""), (3, "漢字 кот"), (4, "word " * 3000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, ids int")
    made = prefixes.round_trip(docs, PATH, PATTERN).collect()
    key = lambda i, n, a, b: (i is None, i or 0, n, a, b)
    expected = []
    for i, t in texts:
        ids = LIBRARY.encode_ordinary(t or "")
        expected.append(key(i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()))
    assert sorted(key(*r) for r in made) == sorted(expected)
    assert prefixes.round_trip(docs.limit(0), PATH, PATTERN).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    from rosterlink.llm.queries import QUERIES, table

    texts = {r.doc_id: r.text or "" for r in table(spark, folder, "documents").collect()}
    for r in QUERIES["op7_prefix_bpe"](spark, folder).collect():
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
