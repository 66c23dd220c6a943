"""Token counts under a unigram vocabulary, with work shared along a trie.

A pre-token is a word with a mark before it. Its best segmentation is the one whose
pieces have the highest sum of log probabilities; the forward score of a prefix is the
best sum up to there. Words with a common prefix have the same forward scores along
it, so distinct words are put in a trie and each node's score is computed once,
from the scores of the nodes above it. A word's last node keeps its count of tokens.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import WORDS

ROWS_AT_ONCE = 1000

# What the vocabulary writes for a space.
MARK = "▁"

# A worker's trie drops its nodes when it has so many (about 300 bytes each), and the counts of
# words not met while so many others came in. Frequent words thus keep theirs.
MOST_NODES = 1_000_000
MOST_WORDS = 300_000

# A character that no piece covers costs so much for each of its bytes, and so many tokens.
BYTE_SCORE = -20.0


def zipf_scores(path: str) -> dict[str, float]:
    """Log probabilities of the pieces of a vocabulary file.

    The file ranks its pieces but gives no probabilities, and no tokenizer is trained
    here, so they follow Zipf's law over the ranks. Control and byte pieces are left out.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    total = math.log(sum(1 / (rank + 1) for rank in range(len(pieces))))
    return {p: -math.log(rank + 1) - total for rank, p in enumerate(pieces)}


class Trie:
    """Nodes by number: the root is 0. ``score`` and ``count`` are those of the best
    segmentation of the characters from the root to the node."""

    def __init__(self, scores: dict[str, float], most: int = MOST_NODES, most_words: int = MOST_WORDS):
        self.most, self.most_words = most, most_words
        # The pieces from their last character back, so that only those are tried that end at a place.
        self.backward: dict = {}
        for piece, own in scores.items():
            at = self.backward
            for character in reversed(piece):
                at = at.setdefault(character, {})
            at[""] = own
        self.terminal: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]

    def insert(self, word: str) -> int:
        """Tokens of a word; only nodes that are new are computed."""
        node, path, child = 0, [0], self.child
        for end, character in enumerate(word, 1):
            below = child.get((node, character))
            if below is None:
                best, tokens = self._best(word, end, path)
                below = child[node, character] = len(self.score)
                self.score.append(best)
                self.count.append(tokens)
            node = below
            path.append(node)
        self.terminal[word] = self.count[node]
        return self.count[node]

    def _best(self, word: str, end: int, path: list[int]) -> tuple[float, int]:
        """Best score and, at equal scores, fewest tokens up to ``end``."""
        score, count = self.score, self.count
        character = word[end - 1]
        size = 1 if character < "\x80" else len(character.encode())
        before = path[end - 1]
        best, tokens = score[before] + size * BYTE_SCORE, count[before] + size
        begin, at = end, self.backward
        while begin:
            begin -= 1
            at = at.get(word[begin])
            if at is None:
                break
            own = at.get("")
            if own is not None:
                before = path[begin]
                own += score[before]
                if own > best or (own == best and count[before] + 1 < tokens):
                    best, tokens = own, count[before] + 1
        return best, tokens

    def counts(self, words: list[str]) -> int:
        """Tokens of all words of a text."""
        known, older = self.terminal, self.older
        total = 0
        for word in words:
            n = known.get(word)
            if n is None:
                n = older.get(word)
                if n is None:
                    n = self.insert(word)
                else:
                    known[word] = n
            total += n
        if len(self.score) > self.most:
            self.clear()
        if len(known) > self.most_words:
            self.older, self.terminal = known, {}
        return total


@functools.lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    """One trie per vocabulary and Python worker."""
    return Trie(zipf_scores(path))


def token_counts(docs: DataFrame, vocabulary: str, id_column: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_tokens``.

    Words are cut at white space from the whole text. A null or empty text has none.
    Rows that repeat or have a null id are counted like any other; extra columns are
    ignored; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie(vocabulary)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                n_words, n_tokens = [], []
                for text in batch.column(1):
                    words = [MARK + w for w in WORDS.findall(text.as_py() or "")]
                    n_words.append(len(words))
                    n_tokens.append(own.counts(words))
                columns = [
                    batch.column(0),
                    pa.array(np.array(n_words, dtype=np.int64)),
                    pa.array(np.array(n_tokens, dtype=np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens"])

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
