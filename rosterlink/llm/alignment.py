"""Aligning the tokens of two tokenizers by the bytes that they cover.

Each text is encoded by both tokenizers. Where a token of A and a token of B end at the same
byte, the two are linked, and the text is cut; the tokens between two cuts are a group.

The ends of a batch are merged in lockstep: one vector holds a pointer into A's ends and one
into B's ends for every document of the batch (a long document has a pointer pair for each stretch of
``STRETCH`` bytes, so that all pairs have about equally far to go). Each step compares the ends under
all pointers at once, emits a link and a cut where they are equal, and moves
the pointer of the lower end, or both. Documents that are through are taken out of the vector.

Counts of linked id pairs over all documents come from a combining aggregation; they are
joined back by pair, by broadcast if their measured size allows, else by a shuffled join that
spreads frequent pairs (``operators/joins.py``).
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.durable import stored
from rosterlink.operators.joins import lookup_join

from .pretokens import MOST_KEPT, Table
from .tokenizer import encoder, packed

# Bytes that one pair of pointers walks over.
STRETCH = 512
# Bytes of text merged at once; a longer text is merged by itself.
BYTES_AT_ONCE = 2**20
# Tokens turned to text at once.
TOKENS_AT_ONCE = 200_000

_PAIR = 2**32

_ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, pairs array<long>, times array<int>"
)


def merged_ends(
    ends_a: np.ndarray, ends_b: np.ndarray, starts: np.ndarray, stops: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ends_a`` and ``ends_b`` (both rising) of the ends that they share.

    ``starts`` and ``stops`` are the byte stretches, in order, that are walked over side by side.
    """
    far = np.array([np.iinfo(np.int64).max])
    a_ends, b_ends = np.concatenate([ends_a, far]), np.concatenate([ends_b, far])
    a, b = np.searchsorted(ends_a, starts, "right"), np.searchsorted(ends_b, starts, "right")
    last_a, last_b = np.searchsorted(ends_a, stops, "right"), np.searchsorted(ends_b, stops, "right")
    links_a, links_b = [], []
    while len(a):
        at_a, at_b = a_ends[a], b_ends[b]
        equal = (at_a == at_b) & (a < last_a)
        links_a.append(a[equal])
        links_b.append(b[equal])
        forward_a, forward_b = at_a <= at_b, at_b <= at_a
        a = a + forward_a
        b = b + forward_b
        going = (a < last_a) | (b < last_b)
        if not going.all():
            a, b, last_a, last_b = a[going], b[going], last_a[going], last_b[going]
    if not links_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found_a, found_b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(found_a, kind="stable")
    return found_a[order], found_b[order]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand
    for themselves, the others are numbered from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteSide:
    """A byte-level vocabulary of the tokenizers library, over the text with a space before it."""

    def __init__(self, path: str):
        self.encoder = encoder(path, MOST_KEPT, True)
        letters = _byte_letters()
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        ids = vocabulary["model"]["vocab"]
        self.bytes_of = [b""] * (1 + max(*ids.values(), 0))
        for token, i in ids.items():
            if all(c in letters for c in token):
                self.bytes_of[i] = bytes(letters[c] for c in token)
        # With every byte in the vocabulary and nothing changed before, tokens make up their text.
        whole = set(map(bytes, ([b] for b in range(256)))) <= set(self.bytes_of)
        self.lossless = whole and vocabulary["normalizer"] is None

    def batch(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text, and whether they are known to make up its bytes."""
        return self.encoder.batch([" " + t for t in texts]), [self.lossless] * len(texts)


class PieceSide:
    """A sentencepiece vocabulary, which puts the space before the text itself.

    No piece holds a mark for a space after another character, or a line feed (checked). So a
    text is cut before each run of spaces and around each line feed, and each distinct part is
    encoded, and compared with the bytes of its tokens, once per worker. A text that holds the mark itself is encoded whole.
    """

    MARK = "▁"

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.bytes_of = [
            b""
            if self.library.is_control(i) or self.library.is_unknown(i)
            else bytes([int(p[3:-1], 16)])
            if self.library.is_byte(i)
            else p.replace(self.MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        joined = [p for p in pieces if "\n" in p or self.MARK in p.lstrip(self.MARK)]
        before = self.library.encode("\n")
        self.separable = not joined and len(before) == 2
        self.cut = re.compile(" +[^ \n]*|[^ \n]+|\n").findall
        self.table = Table(lambda part: self._parts([part])[0], MOST_KEPT)
        # Parts that are not what their tokens make up.
        self.changed: set[str] = set()

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts inside a text: after a line feed, whose two ids are taken off."""
        made = self.library.encode(["\n" + p for p in parts], num_threads=1)
        for part, ids in zip(parts, made, strict=True):
            if b"".join(map(self.bytes_of.__getitem__, ids[2:])) != part.encode():
                self.changed.add(part)
        return [packed(ids[2:]) for ids in made]

    def _whole(self, text: str) -> bytes:
        return packed(self.library.encode([text], num_threads=1)[0])

    def batch(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text, and whether they are known to make up its bytes."""
        cut = [self.cut(" " + t) if self.separable and self.MARK not in t else None for t in texts]
        self.table.tidy()
        self.table.fill(set().union(*(c for c in cut if c)), self._parts)
        get = self.table.__getitem__
        made = [self._whole(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut, strict=True)]
        self.table.drop_long()
        known = [c is not None and not (self.changed and self.changed.intersection(c)) for c in cut]
        if len(self.changed) > MOST_KEPT:
            self.changed.clear()
            self.table.clear()
            self.table.older = {}
        return made, known


class Aligner:
    """Both vocabularies with the lengths of their tokens, and how their ids are written."""

    def __init__(self, side_a: ByteSide, side_b: PieceSide):
        self.a, self.b = side_a, side_b
        self.length_a = np.array([len(x) for x in side_a.bytes_of], dtype=np.int64)
        self.length_b = np.array([len(x) for x in side_b.bytes_of], dtype=np.int64)
        # An id of A before another and at the end of its list, then those of B.
        written = [b"%d" % i for i in range(max(len(self.length_a), len(self.length_b)))]
        na, nb = len(self.length_a), len(self.length_b)
        self.written = [
            *(x + b"," for x in written[:na]),
            *(x + b"|" for x in written[:na]),
            *(x + b"," for x in written[:nb]),
            *(x + b";" for x in written[:nb]),
        ]
        self.first_b = 2 * na

    def covers(self, ids: np.ndarray, bytes_of: list[bytes], lengths: np.ndarray, raw: bytes) -> bool:
        """Whether the bytes of the tokens, joined, are ``raw``."""
        if int(lengths[ids].sum()) != len(raw):
            return False
        at = 0
        for first in range(0, len(ids), TOKENS_AT_ONCE):
            own = b"".join(map(bytes_of.__getitem__, ids[first : first + TOKENS_AT_ONCE].tolist()))
            if raw[at : at + len(own)] != own:
                return False
            at += len(own)
        return True

    def align(self, texts: list[str | None]) -> list[tuple]:
        """``n_a, n_b, n_links, sha256, pairs, times`` of each text."""
        nothing = (0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))
        made = [nothing] * len(texts)
        filled = [i for i, t in enumerate(texts) if t]
        if not filled:
            return made
        own = [texts[i] for i in filled]
        (made_a, known_a), (made_b, known_b) = self.a.batch(own), self.b.batch(own)
        ids_a = [np.frombuffer(x, "<u4") for x in made_a]
        ids_b = [np.frombuffer(x, "<u4") for x in made_b]
        kept, sizes = [], []
        for k, text in enumerate(own):
            raw = b" " + text.encode()
            if (known_a[k] or self.covers(ids_a[k], self.a.bytes_of, self.length_a, raw)) and (
                known_b[k] or self.covers(ids_b[k], self.b.bytes_of, self.length_b, raw)
            ):
                kept.append(k)
                sizes.append(len(raw))
        if not kept:
            return made
        a = np.concatenate([ids_a[k] for k in kept]).astype(np.int64)
        b = np.concatenate([ids_b[k] for k in kept]).astype(np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        borders = np.cumsum([0, *sizes])
        starts = np.concatenate([np.arange(x, y, STRETCH) for x, y in zip(borders, borders[1:], strict=False)])
        stops = np.concatenate([starts[1:], borders[-1:]])
        links_a, links_b = merged_ends(ends_a, ends_b, starts, stops)
        # The text of the groups: A's tokens of a group, then B's.
        cut_a, cut_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        cut_a[links_a], cut_b[links_b] = 1, 1
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        b_before = np.concatenate([[0], links_b + 1])
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + b_before[group_a]] = a + cut_a * len(self.length_a)
        codes[np.arange(len(b)) + links_a[group_b] + 1] = b + self.first_b + cut_b * len(self.length_b)
        keys = a[links_a] * _PAIR + b[links_b]
        last_a = np.searchsorted(ends_a, borders[1:], "right")
        last_b = np.searchsorted(ends_b, borders[1:], "right")
        last_link = np.searchsorted(links_a, last_a, "left")
        a0 = b0 = link0 = 0
        for k, a1, b1, link1 in zip(kept, last_a.tolist(), last_b.tolist(), last_link.tolist(), strict=True):
            pairs, times = np.unique(keys[link0:link1], return_counts=True)
            digest = self._digest(codes[a0 + b0 : a1 + b1])
            made[filled[k]] = (a1 - a0, b1 - b0, link1 - link0, digest, pairs, times.astype(np.int32))
            a0, b0, link0 = a1, b1, link1
        return made

    def _digest(self, codes: np.ndarray) -> str:
        summed = hashlib.sha256()
        for first in range(0, len(codes), TOKENS_AT_ONCE):
            own = b"".join(map(self.written.__getitem__, codes[first : first + TOKENS_AT_ONCE].tolist()))
            summed.update(own if first + TOKENS_AT_ONCE < len(codes) else own[:-1])
        return summed.hexdigest()


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per pair of files and Python worker."""
    return Aligner(ByteSide(path_a), PieceSide(path_b))


def _groups_of(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > most:
            yield first, i
            first, size = i, 0
        size += len(text or "") + 1
    if first < len(texts):
        yield first, len(texts)


def aligned(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id") -> DataFrame:
    """One row per document, ``row`` a number of its own, with its distinct linked pairs of
    ids (``a * 2**32 + b``) and how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            texts = batch.column(2)
            for whole in range(0, batch.num_rows, 500):
                some = texts.slice(whole, 500).to_pylist()
                for first, stop in _groups_of(some, BYTES_AT_ONCE):
                    made = own.align(some[first:stop])
                    part = batch.slice(whole + first, stop - first)
                    n_a, n_b, links, digests, pairs, times = zip(*made, strict=True)
                    borders = pa.array(np.cumsum([0, *map(len, pairs)]).astype(np.int32))
                    columns = [
                        part.column(0),
                        part.column(1),
                        *(pa.array(c, pa.int64()) for c in (n_a, n_b, links, links)),
                        pa.array(digests, pa.string()),
                        pa.ListArray.from_arrays(borders, pa.array(np.concatenate(pairs))),
                        pa.ListArray.from_arrays(borders, pa.array(np.concatenate(times))),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, _NAMES)

    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), "text"
    )
    return narrow.mapInArrow(run, _ALIGNED)


_NAMES = [c.split()[0] for c in _ALIGNED.split(", ")]


def pair_counts(table: DataFrame) -> DataFrame:
    """``pair``, ``count`` over all documents, and ``best``: whether no pair with the same id of
    B has a higher count. At most one row for each pair of ids of the two vocabularies."""
    each = table.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = stored(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count")))
    of_b = F.col("pair") % F.lit(_PAIR)
    highest = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("highest"))
    joined = counts.withColumn("b", of_b).join(highest, "b")
    return stored(joined.select("pair", "count", (F.col("count") == F.col("highest")).alias("best")))


def align(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_column: str = "doc_id",
    *,
    broadcast: bool | None = None,
) -> DataFrame:
    """One row per document: the columns of ``aligned`` but for the pairs, ``n_best`` and ``count_sum``.

    ``n_best`` counts links whose pair has the highest count of its id of B, over all documents;
    ``count_sum`` adds up the counts of the pairs of all links. A null or empty text, and one whose tokens of either side
    do not make up its bytes, has no tokens: zeros and an empty ``groups_sha256``. Special tokens'
    strings are ordinary text. Rows that share an id or have none are documents of their own;
    extra columns are ignored; no rows give an empty table. ``broadcast`` overrides the measured
    size of the pair counts.
    """
    table = stored(aligned(docs, path_a, path_b, id_column), compression="zstd")
    counts = pair_counts(table)
    each = table.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")
    )
    found = lookup_join(each, counts, ["pair"], "inner", seq="row", broadcast=broadcast)
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    )
    kept = table.drop("pairs", "times")
    zero = F.lit(0).cast("long")
    return (
        kept.join(sums, "row", "left")
        .drop("row")
        .withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})
    )
