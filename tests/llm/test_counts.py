"""Trie counts against a word-by-word dynamic programme."""

import re

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlink.llm import counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCORES = counts.zipf_scores(PATH)
TRIE = counts.Trie(SCORES)


def alone(word, scores=SCORES):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        found = [(best[end - 1][0] + size * counts.BYTE_SCORE, best[end - 1][1] - size)]
        for begin in range(end):
            if word[begin:end] in scores:
                found.append((best[begin][0] + scores[word[begin:end]], best[begin][1] - 1))
        best.append(max(found))
    return -best[-1][1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("theroanid"), st.characters(exclude_categories=["Cs"])), max_size=15)))
def test_shared_trie(words):
    words = [counts.MARK + w for w in words]
    assert TRIE.counts(words) == sum(map(alone, words))


def test_prefixes_are_computed_once():
    trie = counts.Trie(SCORES)
    trie.insert("▁nation")
    size = len(trie.score)
    trie.insert("▁nation")
    trie.insert("▁nat")
    assert len(trie.score) == size
    trie.insert("▁national")
    assert len(trie.score) == size + 2 and trie.terminal["▁nat"] == alone("▁nat")


def test_emptied_trie_counts_the_same():
    words = [f"▁w{i}" for i in range(300)]
    small = counts.Trie(SCORES, most=50)
    assert [small.counts([w]) for w in words] == [alone(w) for w in words]


def test_operator(spark):
    texts = [(1, "the Nation's  words\x1c é"), (1, None), (None, ""), (2, "x" * 3000), (3, "a b " * 2000)]
    docs = spark.createDataFrame([(i, t, "y") for i, t in texts], "doc_id long, text string, n_words string")
    made = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_tokens) for r in counts.token_counts(docs, PATH).collect())
    expected = []
    for i, t in texts:
        words = ["▁" + w for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        expected.append((i is None, i or 0, len(words), sum(map(alone, words))))
    assert made == sorted(expected)
    assert counts.token_counts(docs.limit(0), PATH).count() == 0
