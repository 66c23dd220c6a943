"""Cutting text into pre-tokens, with a table of what each distinct one becomes.

Byte-pair tokenizers cut a text by a pattern and encode each match by itself, so
the encoding of a text is that of its pre-tokens in order. Most pre-tokens are
repeats; a table per Python worker encodes each distinct one once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

# Code points whose categories, lower case and composition no Unicode version has
# changed: Latin letters, and the usual dashes, quotes and dots. Texts that hold
# others are left to the library as a whole.
PLAIN = [*range(0x180), *range(0x2010, 0x2028)]
_OTHER = re.compile("[^\\x00-\\u017f\\u2010-\\u2027]")

# Unicode white space among them.
SPACE = "\\t-\\r \\x85\\xa0"

# A worker's table holds about so many pre-tokens (about 230 bytes each).
MOST_KEPT = 400_000

# Pre-tokens longer than this (characters) are not kept.
LONGEST_KEPT = 100


def _of_category(letter: str) -> str:
    return "".join(f"\\u{c:04x}" for c in PLAIN if unicodedata.category(chr(c))[0] == letter)


LETTERS, NUMBERS = _of_category("L"), _of_category("N")


def byte_level_pattern() -> re.Pattern:
    """The split of the byte-level vocabularies, for plain texts.

    Words, the commonest match, are tried first; no other alternative matches where they do.
    """
    return re.compile(
        f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBERS}]+"
        f"| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


def word_pattern() -> re.Pattern:
    """The split of the lower-case word vocabulary, for plain texts in lower case."""
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+"
    )


def is_plain(text: str) -> bool:
    return text.isascii() or not _OTHER.search(text)


class Table(dict):
    """What each pre-token becomes, made when first asked for.

    Entries that were not asked for while ``most / 2`` others came in are dropped.
    """

    def __init__(self, make: Callable[[str], bytes], most: int = MOST_KEPT):
        super().__init__()
        self.make, self.most = make, most
        self.older: dict[str, bytes] = {}
        self.long: list[str] = []

    def __missing__(self, piece: str) -> bytes:
        made = self.older.get(piece)
        if made is None:
            made = self.make(piece)
        self[piece] = made
        return made

    def fill(self, pieces: set[str], make: Callable[[list[str]], list[bytes]]) -> None:
        """Enter all of ``pieces``; those that are new are made in one call."""
        new = pieces.difference(self)
        older = self.older
        missing = list(new.difference(older)) if older else list(new)
        if len(missing) < len(new):
            # Not by intersection(), which would go through all of the older table.
            self.update((p, older[p]) for p in new if p in older)
        self.update(zip(missing, make(missing), strict=True))
        self.long += [p for p in missing if len(p) > LONGEST_KEPT]

    def drop_long(self) -> None:
        """Forget new entries that are too long to keep."""
        for piece in self.long:
            self.pop(piece, None)
        self.long.clear()

    def tidy(self) -> None:
        """Keep memory bounded; only time is lost."""
        if len(self) > self.most // 2:
            self.older = dict(self)
            self.clear()
