"""Byte-level BPE by dynamic programming over prefixes.

Every byte prefix of a piece has one valid encoding, and so one last token. It is the
token that ends there whose neighbour, the last token of the prefix before it, would
not have merged with it or with a part of it. So a table of last tokens,
filled from left to right, encodes a piece; appending bytes adds entries and changes
none, and an edit leaves the entries before it as they are.

Whether two tokens can stand side by side is read from how merging builds each of
them: a pair is invalid if, at some time, what is then the right end of the first and
the left end of the second would have merged.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Table, byte_level_pattern, is_plain
from .tokenizer import packed

ROWS_AT_ONCE = 1000

_NEVER = float("inf")

# Characters of texts that are cut before new pre-tokens are encoded; a longer text stands alone.
CHARACTERS_AT_ONCE = 4_000_000

# A worker's memory of pairs is emptied when it holds so many.
MOST_PAIRS = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merged(ranks: dict[bytes, int], piece: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
    """Merge a piece from single bytes on; also the last pair that was merged."""
    parts, last = [piece[i : i + 1] for i in range(len(piece))], None
    while True:
        pairs = [
            (r, i)
            for i in range(len(parts) - 1)
            if (r := ranks.get(parts[i] + parts[i + 1])) is not None
        ]
        if not pairs:
            return parts, last
        _, i = min(pairs)
        last = parts[i], parts[i + 1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


class PrefixEncoder:
    """Encoding of pieces over one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        # Tokens that merging reaches, with the pair whose merge makes them. Others
        # stand only for a piece that they equal as a whole.
        self.made_of: dict[bytes, tuple[bytes, bytes] | None] = {}
        for token in ranks:
            parts, last = merged(ranks, token)
            if len(parts) == 1:
                self.made_of[token] = last
        self.longest = max(map(len, self.made_of), default=1)
        # What tokens begin with. The longest of them that text ends with so far is the state of the
        # search for the tokens that end there; steps between states are found when first taken.
        self.begins = {t[:n] for t in self.made_of for n in range(len(t) + 1)}
        self.states: dict[bytes, tuple] = {}
        self.ends: dict[tuple[bytes, int], list] = {}
        # For each token, the tokens that have been tried before it, and whether they fit.
        self.after: dict[bytes, dict[bytes, bool]] = {}
        self.n_pairs = 0

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, float, float]]:
        """What stands at the left (0) or right (1) end of a token while it is built:
        part, when it is made, when it merges into the next."""
        known = self.ends.get((token, side))
        if known is None:
            known, until, part = [], _NEVER, token
            while True:
                pair = self.made_of[part]
                born = -1 if pair is None else self.ranks[part]
                known.append((part, born, until))
                if pair is None:
                    break
                part, until = pair[side], born
            self.ends[token, side] = known
        return known

    def _state(self, begin: bytes) -> tuple[dict[int, tuple], list[tuple], bytes]:
        """Steps taken from a state so far; the tokens that end there, longest first, each
        with its length and what has been tried before it; the state's bytes."""
        known = self.states.get(begin)
        if known is None:
            ending = [begin[i:] for i in range(len(begin)) if begin[i:] in self.made_of]
            known = {}, [(t, len(t), self.after.setdefault(t, {})) for t in ending], begin
            self.states[begin] = known
        return known

    def _step(self, state: tuple, byte: int) -> tuple:
        text = state[2] + bytes((byte,))
        while text not in self.begins:
            text = text[1:]
        state[0][byte] = found = self._state(text)
        return found

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether ``left`` and ``right`` stay two tokens when side by side."""
        tried = self.after.setdefault(right, {})
        known = tried.get(left)
        if known is None:
            known = tried[left] = self._fits(left, right)
            self.n_pairs += 1
        return known

    def forget(self) -> None:
        """Empty the memory of pairs."""
        for tried in self.after.values():
            tried.clear()
        self.n_pairs = 0

    def _fits(self, left: bytes, right: bytes) -> bool:
        get = self.ranks.get
        for a, born_a, until_a in self._edge(left, 1):
            for b, born_b, until_b in self._edge(right, 0):
                rank = get(a + b)
                if rank is None:
                    continue
                at = max(rank, born_a, born_b)
                # At equal ranks the leftmost pair merges first.
                if at < until_a and at <= until_b:
                    return False
        return True

    def extend(self, text: bytes, last: list[bytes]) -> list[bytes]:
        """Fill the table for ``text``, of which ``last`` has the first entries.

        ``last[i]`` is the last token of the first ``i + 1`` bytes. To append bytes,
        pass the table so far; after an edit, pass the part before the edit.
        """
        done = len(last)
        state = self._state(b"")
        for byte in text[max(0, done - self.longest) : done]:
            state = state[0].get(byte) or self._step(state, byte)
        for end, byte in enumerate(text[done:], done + 1):
            state = state[0].get(byte) or self._step(state, byte)
            for token, length, tried in state[1]:
                if length == end:
                    last.append(token)
                    break
                left = last[end - length - 1]
                known = tried.get(left)
                if known or known is None and self.fits(left, token):
                    last.append(token)
                    break
        return last

    def tokens(self, text: bytes, last: list[bytes] | None = None) -> list[bytes]:
        """The encoding of a piece, read from the table's end."""
        last = self.extend(text, []) if last is None else last
        found, end = [], len(text)
        while end:
            found.append(last[end - 1])
            end -= len(last[end - 1])
        return found[::-1]

    def ids(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. A piece takes over the table of the one before it as far as both
        begin alike, so sorted pieces cost least."""
        made, ranks, before, last = [], self.ranks, b"", []
        for piece in pieces:
            if piece in ranks:
                made.append([ranks[piece]])
                continue
            if self.n_pairs > MOST_PAIRS:
                self.forget()
            same = 0
            for a, b in zip(piece, before, strict=False):
                if a != b:
                    break
                same += 1
            del last[same:]
            before, found, end = piece, [], len(piece)
            self.extend(piece, last)
            while end:
                token = last[end - 1]
                found.append(ranks[token])
                end -= len(token)
            made.append(found[::-1])
        return made

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class TextPrefixEncoder:
    """Whole texts: each match of the split is encoded by itself, each distinct one once."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.pieces = PrefixEncoder(read_ranks(path))
        self.any_text = regex.compile(pattern)
        self.cut = byte_level_pattern().findall
        self.table = Table(lambda x: self._missing([x])[0])
        known = self.pieces.bytes_of
        self.bytes_of = pa.array([known.get(i) for i in range(max(known) + 1)], pa.binary())

    def _missing(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens, which are encoded in sorted order."""
        order = sorted(pieces)
        made = dict(zip(order, self.pieces.ids([x.encode() for x in order]), strict=True))
        return [packed(made[x]) for x in pieces]

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        made, first, size = [], 0, 0
        for i, text in enumerate(texts):
            if size and size + len(text) > CHARACTERS_AT_ONCE:
                made += self._some(texts[first:i])
                first, size = i, 0
            size += len(text)
        return made + self._some(texts[first:])

    def _some(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(x) if is_plain(x) else self.any_text.findall(x) for x in texts]
        table = self.table
        table.tidy()
        table.fill(set().union(*cut), self._missing)
        get = table.__getitem__
        made = [b"".join(map(get, c)) for c in cut]
        table.drop_long()
        return made

    def ids(self, text: str) -> bytes:
        return self.batch([text])[0]

    def decode_batch(self, ids: list[bytes]) -> pa.Array:
        """The bytes that the ids of each text stand for."""
        borders = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)))
        found = self.bytes_of.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        _, offsets, data = found.buffers()
        at = np.frombuffer(offsets, np.int32)[borders] if len(found) else np.zeros(len(borders), np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at), data or pa.py_buffer(b"")])

    def decode(self, ids: bytes) -> bytes:
        return self.decode_batch([ids])[0].as_py()


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> TextPrefixEncoder:
    """One encoder per vocabulary and Python worker."""
    return TextPrefixEncoder(path, pattern)


def round_trip(
    docs: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id"
) -> DataFrame:
    """Encode whole texts and decode the ids again.

    Columns: ``doc_id``, ``n_tokens``, ``ids`` (binary, little-endian 32-bit),
    ``decoded`` (binary, the bytes that the ids stand for). A null or empty text has
    no ids. Rows that repeat or have a null id are encoded like any other; extra
    columns are ignored; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks, pattern)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                ids = own.batch([x or "" for x in batch.column(1).to_pylist()])
                columns = [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    own.decode_batch(ids),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


