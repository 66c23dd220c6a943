"""Encoding texts with the tokenizers library, each distinct pre-token once."""

from __future__ import annotations

import functools
import os
import sys
from array import array

import numpy as np

from .pretokens import LONGEST_KEPT, MOST_KEPT, Table, byte_level_pattern, is_plain, word_pattern

LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


# Words that one call of the library gets.
WORDS_AT_ONCE = 500


# How byte-level vocabularies write bytes as characters: printable ones of Latin-1 as themselves, the
# others, in order, from U+0100 on (fixed by their publisher).
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - _PRINTABLE))}
SPACE_LETTER = chr(BYTE_LETTERS[0x20])


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if LITTLE else np.array(ids, dtype="<u4").tobytes()


class TextEncoder:
    """Ids of whole texts, equal to what the library returns for them.

    Plain texts (see ``pretokens.PLAIN``) are cut by the vocabulary's own split and each distinct
    pre-token is encoded by the library once per worker: byte-level ones by its model, which does not split them
    again, others as far as a batch lacks them in one call. Any other text, and
    one that holds the string of an added token, goes to the library as it is. With ``special_as_text``
    such strings are ordinary text.
    """

    def __init__(self, path: str, most: int = MOST_KEPT, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        added = self.library.get_added_tokens_decoder().values()
        self.added = [] if special_as_text else [t.content.lower() for t in added]
        self.lower = self.library.normalizer is not None
        self.cut = (word_pattern() if self.lower else byte_level_pattern()).findall
        self.tokenize = self.library.model.tokenize
        self.table = Table((lambda piece: self._whole([piece])[0]) if self.lower else self._piece, most)
        vocabulary = self.library.get_vocab()
        # Tokens that end a word: there, words in one text are told apart again.
        self.ending = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ending[i] = token.endswith("</w>")

    def _whole(self, texts: list[str]) -> list[bytes]:
        made = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [packed(x.ids) for x in made]

    def _piece(self, piece: str) -> bytes:
        """Ids of a byte-level pre-token."""
        if len(piece) > LONGEST_KEPT:
            self.table.long.append(piece)
        if piece.isascii() and piece.isprintable():
            letters = piece.replace(" ", SPACE_LETTER)
        else:
            letters = piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        return packed([t.id for t in self.tokenize(letters)])

    def _words(self, words: list[str]) -> list[bytes]:
        """Words of letters, many in one text: one call of the library costs less than many."""
        made = []
        for first in range(0, len(words), WORDS_AT_ONCE):
            some = words[first : first + WORDS_AT_ONCE]
            whole = self._whole([" ".join(some)])[0]
            ids = np.frombuffer(whole, "<u4")
            end = np.flatnonzero(self.ending[ids]) + 1
            begin = np.append(0, end[:-1])
            if len(begin) == len(some) and len(ids) and begin[0] == 0 and end[-1] == len(ids):
                made += [whole[4 * a : 4 * b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            else:
                made += self._whole(some)
        return made

    def _missing(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens of the lower-case word vocabulary."""
        bare = [p for p in pieces if p.isalpha()]
        made = dict(zip(bare, self._words(bare), strict=True))
        others = [p for p in pieces if p not in made]
        made.update(zip(others, self._whole(others), strict=True))
        return [made[p] for p in pieces]

    def _pieces(self, text: str) -> list[str] | None:
        if not is_plain(text):
            return None
        if self.lower or (self.added and "<" in text):
            lower = text.lower()
            if any(t in lower for t in self.added):
                return None
            text = lower if self.lower else text
        return self.cut(text)

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._pieces(text) for text in texts]
        table = self.table
        table.tidy()
        if self.lower:
            table.fill(set().union(*(c for c in cut if c)), self._missing)
        get = table.__getitem__
        made = [b"" if c is None else b"".join(map(get, c)) for c in cut]
        for i, c in enumerate(cut):
            if c is None:
                made[i] = self._whole([texts[i]])[0]
        table.drop_long()
        return made

    def ids(self, text: str) -> bytes:
        return self.batch([text])[0]


@functools.lru_cache(maxsize=4)
def encoder(path: str, most: int = MOST_KEPT, special_as_text: bool = False) -> TextEncoder:
    """One encoder per file and Python worker."""
    return TextEncoder(path, most, special_as_text)
