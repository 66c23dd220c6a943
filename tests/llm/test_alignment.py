"""Alignment against a plain walk over both libraries' tokens."""

import functools
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rosterlink.llm import alignment
from rosterlink.llm.queries import QUERIES, table

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@functools.cache
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def byte_of_letter():
    keep = list(range(ord("!"), ord("~") + 1)) + list(range(0xA1, 0xAD)) + list(range(0xAE, 0x100))
    table, n = {}, 0
    for b in range(256):
        if b in keep:
            table[chr(b)] = b
        else:
            table[chr(256 + n)] = b
            n += 1
    return table


LETTERS = byte_of_letter()


def tokens(text):
    """Ids and bytes of both sides, or nothing."""
    if not text:
        return [], []
    a, b = libraries()
    one = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(LETTERS[c] for c in t)) for i, t in zip(one.ids, one.tokens, strict=True)]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    if b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
        return [], []
    return left, right


def walked(text):
    """Groups of ids, and the linked pairs."""
    left, right = tokens(text)
    ends_a = np.cumsum([len(x) for _, x in left]).tolist()
    ends_b = np.cumsum([len(x) for _, x in right]).tolist()
    common = sorted(set(ends_a) & set(ends_b))
    groups, pairs, i, j = [], [], 0, 0
    for end in common:
        x, y = i, j
        while i < len(ends_a) and ends_a[i] <= end:
            i += 1
        while j < len(ends_b) and ends_b[j] <= end:
            j += 1
        groups.append(([t for t, _ in left[x:i]], [t for t, _ in right[y:j]]))
        pairs.append((left[i - 1][0], right[j - 1][0]))
    return len(left), len(right), groups, pairs


def expected(texts):
    made = [walked(t) for t in texts]
    counts = Counter(p for m in made for p in m[3])
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    for n_a, n_b, groups, pairs in made:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        best = sum(counts[p] == highest[p[1]] for p in pairs)
        yield n_a, n_b, len(groups), len(pairs), best, sum(counts[p] for p in pairs), digest


def test_registered_query(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    made = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_alignment"](spark, "/root/testdata/sf0.001").collect()}
    assert made == dict(zip([r.doc_id for r in docs], expected([r.text for r in docs]), strict=True))


ODD = [
    None, "", " ", "  a  b ", "\n", "\n\n a\n b \n", "<|endoftext|> <s> </s> <unk> <0x0A>", "x▁y", "é漢字🙂  　",
    "tab\tand\r\nreturn", "a" * 3000, "word " * 2000, "\x00\x01", "it's 'll", "same text", "same text", "ﬁ ½ ① Å",
]


@pytest.mark.parametrize("broadcast", [True, False])
def test_odd_texts(spark, broadcast, monkeypatch):
    rows = [(i % 4 or None, t, "x", 1, "y") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair string, row int, count string").repartition(3)
    made = alignment.align(docs, A, B, broadcast=broadcast).collect()
    want = [(i % 4 or None, *e) for i, e in enumerate(expected(ODD))]
    key = repr
    assert sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in made), key=key) == sorted(want, key=key)
    assert alignment.align(docs.limit(0), A, B).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\tabeé<s>'1漢▁"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_random_texts(texts):
    made = alignment.aligner(A, B).align(texts)
    for (n_a, n_b, links, digest, pairs, times), want, text in zip(made, expected(texts), texts, strict=True):
        assert (n_a, n_b, links, digest) == (want[0], want[1], want[3], want[6])
        own = Counter(a * 2**32 + b for a, b in walked(text)[3])
        assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == own


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9), st.integers(1, 40), st.integers(0, 2**30))
def test_lockstep_merge(stretch, size, seed):
    random = np.random.default_rng(seed)
    a = np.unique(np.append(random.integers(1, size + 1, size), size))
    b = np.unique(np.append(random.integers(1, size + 1, size // 3), size))
    starts = np.arange(0, size, stretch)
    links_a, links_b = alignment.merged_ends(a, b, starts, np.append(starts[1:], size))
    assert a[links_a].tolist() == b[links_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
