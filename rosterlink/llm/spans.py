"""Removing repeated stretches of bytes by a Burrows-Wheeler transform.

A start is a byte at which a whole string of ``length`` bytes begins. The bytes of a
string that also starts earlier (in a document of a smaller id, or earlier in the same one) go.

1. Every start belongs to an anchor: the ``GRAM`` bytes inside its string with the lowest hash.
   Equal strings have equal anchors at the same place. Starts in a row with one anchor are a record:
   at most ``length - GRAM + 1`` starts, and the bytes of their strings. A record is known by the
   anchor's hash (its key) and a hash of its bytes. Equal records inside a chunk of texts are settled
   at once, so copies by the thousand come to one record per chunk.
2. Records are brought together by key. Of equal records the first stays; the others' starts are all
   repeats. A key with one kind of record is done. Only the first records of other keys need their bytes.
3. Those are fetched from the texts and brought together by key, many keys to a unit of
   ``UNIT`` bytes. A unit's suffixes are sorted to the bounded length and transformed. Intervals of suffixes with a common
   prefix are extended backwards, breadth first: from the interval of a string the intervals of all strings
   one byte longer to the left. Whenever an interval ends where no common prefix is known yet, its value is
   the number of the round; so common prefixes come by increasing value, each once, and after ``length``
   rounds the ends still open are those of strings of ``length`` bytes and more in common.
   In each such run of suffixes the first start stays, the others are repeats.
4. A key with more than ``MOST_RECORDS`` records (a passage that a large share of documents
   hold, in ever different surroundings) is not gathered: each of its starts goes by a 128-bit hash of its whole string, the
   first of equal ones is found by a combining aggregation, and joined back with frequent ones spread.
5. The runs of repeated starts come to their documents, which are cut.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterlink.durable import discard, stored
from rosterlink.operators.joins import lookup_join

LENGTH = 100
GRAM = 32
# Bytes of texts in a chunk, and of records in a unit.
CHUNK = 2**21
UNIT = 2**20
MOST_RECORDS = 4096
ROWS_AT_ONCE = 500

# Rows without an id come after all others.
_LAST = 2**63 - 1

_RECORDS = "key long, bytes_hash long, doc long, row long, at int, n int"
_RUNS = "row long, at int, n int"

_random = np.random.default_rng(1207)
_BYTE = _random.integers(0, 2**64, 256, dtype=np.uint64)
_FACTORS = [np.uint64(int(x) | 1) for x in _random.integers(0, 2**63, 64)]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) from each byte on."""
    made, width, step = _BYTE[data], 1, 0
    while width < gram:
        made = made[:-width] * _FACTORS[step] + made[width:]
        made ^= made >> np.uint64(29)
        width, step = width * 2, step + 1
    return made


def lowest_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes, the place of the lowest (the first of equal ones).

    Of each hash as many bits count as its place leaves free.
    """
    bits = np.uint64(max(1, len(hashes).bit_length()))
    made = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        made = np.minimum(made[:-step], made[step:])
        covered += step
    return (made & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def records_of(
    data: np.ndarray, firsts: np.ndarray, counts: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``first start, number of starts, key`` of all records of a chunk.

    ``firsts`` and ``counts`` are the starts of each text that are to be covered.
    """
    nothing = np.zeros(0, np.int64)
    if not counts.sum():
        return nothing, nothing, nothing
    hashes = gram_hashes(data, GRAM)
    anchors = lowest_places(hashes, length - GRAM + 1)
    starts = np.repeat(firsts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    own = anchors[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    sizes = np.diff(np.append(begin, len(starts)))
    return starts[begin], sizes, hashes[own[begin]].view(np.int64)


def joined_runs(row: np.ndarray, at: np.ndarray, n: np.ndarray):
    """Runs of starts, given in order, with those that follow on each other joined."""
    if not len(row):
        return row, at, n
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + n[:-1])
    begin = np.flatnonzero(new)
    return row[begin], at[begin], np.add.reduceat(n, begin)


def _chunks(batches: Iterator[pa.RecordBatch], length: int, most: int):
    """Lists of ``doc, row, offset, bytes, starts`` of about ``most`` bytes, in order of documents.

    A longer text comes in pieces, each with the bytes that its last starts need.
    """
    waiting, size = [], 0
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(first, ROWS_AT_ONCE)
            docs, rows = part.column(0).to_pylist(), part.column(1).to_pylist()
            for doc, row, text in zip(docs, rows, part.column(2), strict=True):
                raw = text.as_py()
                total = len(raw or b"") - length + 1
                for at in range(0, total, most):
                    starts = min(most, total - at)
                    if size and size + starts > most:
                        yield sorted(waiting)
                        waiting, size = [], 0
                    waiting.append((doc, row, at, raw[at : at + starts + length - 1], starts))
                    size += starts + length - 1
    if waiting:
        yield sorted(waiting)


def records(texts: DataFrame, length: int, chunk: int = CHUNK) -> DataFrame:
    """The records of all texts (``doc, row, text`` with binary text), each once per chunk.

    Rows without a key are runs of starts that repeat inside their chunk.
    """
    names = [c.split()[0] for c in _RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _chunks(batches, length, chunk):
            data = np.frombuffer(b"".join(c[3] for c in own), dtype=np.uint8)
            borders = np.cumsum([0, *(len(c[3]) for c in own)])
            counts = np.array([c[4] for c in own])
            begin, n, key = records_of(data, borders[:-1], counts, length)
            held, digest = memoryview(data), xxhash.xxh3_64_intdigest
            ends = (begin + n + length - 1).tolist()
            sums = [digest(held[a:b]) for a, b in zip(begin.tolist(), ends, strict=True)]
            sums = np.array(sums, dtype=np.uint64).view(np.int64)
            order = np.lexsort((begin, sums, key))
            same = (key[order][1:] == key[order][:-1]) & (sums[order][1:] == sums[order][:-1])
            repeat = np.zeros(len(begin), dtype=bool)
            repeat[order[1:][same]] = True
            of = np.searchsorted(borders, begin, "right") - 1
            doc = np.array([c[0] for c in own])[of]
            row = np.array([c[1] for c in own])[of]
            at = begin - borders[of] + np.array([c[2] for c in own])[of]
            first = ~repeat
            columns = [key[first], sums[first], doc[first], row[first], at[first].astype(np.int32), n[first].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
            row, at, n = joined_runs(row[repeat], at[repeat], n[repeat])
            if len(row):
                none = pa.nulls(len(row), pa.int64())
                columns = [none, none, none, pa.array(row), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts.select("doc", "row", "text").mapInArrow(run, _RECORDS)


def _symbols(strings: list[bytes]) -> np.ndarray:
    """All strings in one, each followed by a zero; bytes are numbered from one."""
    ends = np.cumsum([len(s) + 1 for s in strings])
    data = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8).astype(np.uint16) + 1
    data[ends - 1] = 0
    return data


def suffix_order(data: np.ndarray, length: int) -> np.ndarray:
    """Places in the order of their next ``length`` symbols (or more), read round the end."""
    packed = np.zeros(len(data), dtype=np.int64)
    for i in range(7):
        packed = packed << 9 | np.roll(data, -i)
    order, known = np.argsort(packed), 7
    while True:
        ranks = np.empty(len(data), dtype=np.int64)
        own = packed[order]
        ranks[order] = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]]))
        if known >= length or ranks[order[-1]] == len(data) - 1:
            return order
        packed = ranks * len(data) + np.roll(ranks, -known)
        order, known = np.argsort(packed), known * 2


def common_prefixes(last: np.ndarray, length: int) -> np.ndarray:
    """For each place in the order of suffixes, what it shares with the one before, from the
    transform ``last``: the symbols before the suffixes.

    Values below ``length`` are exact; -1 stands for ``length`` and more. The first place has 0.
    """
    size = len(last)
    order = np.argsort(last, kind="stable")
    to = np.empty(size, dtype=np.int64)
    to[order] = np.arange(size)
    symbol = last[order]
    same = symbol[1:] == symbol[:-1]
    before, after = np.full(size, -1), np.full(size, size)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    shared = np.full(size + 1, -1)
    shared[0] = shared[size] = 0
    low, high = np.zeros(1, np.int64), np.full(1, size)
    for value in range(length):
        sizes = high - low
        single = sizes == 1
        found_low, found_high = [to[low[single]]], [to[low[single]] + 1]
        low, high, sizes = low[~single], high[~single], sizes[~single]
        if len(low):
            # The first and the last suffix of the interval behind each symbol.
            at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            found_low.append(np.sort(to[at[before[at] < np.repeat(low, sizes)]]))
            found_high.append(np.sort(to[at[after[at] >= np.repeat(high, sizes)]]) + 1)
        low, high = np.concatenate(found_low), np.concatenate(found_high)
        new = shared[high] < 0
        low, high = low[new], high[new]
        if not len(low):
            break
        shared[high] = value
    return shared[:size]


def repeated_starts(strings: list[bytes], counts: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Which of the first ``counts`` starts of each string repeat one of a string (or place in
    it) that comes before it by ``order``; one flag per start, string by string."""
    data = _symbols(strings)
    places = suffix_order(data, length + 1)
    shared = common_prefixes(data[places - 1], length)
    borders = np.cumsum([0, *(len(s) + 1 for s in strings)])[:-1]
    starts = np.repeat(borders - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    rank = np.full(len(data), -1)
    rank[starts] = np.repeat(order, counts) * 2**20 + starts - np.repeat(borders, counts)
    group = np.cumsum(shared >= 0)
    own = rank[places]
    use = own >= 0
    group, own, places = group[use], own[use], places[use]
    by = np.lexsort((own, group))
    again = np.zeros(len(data), dtype=bool)
    again[places[by[1:][group[by][1:] == group[by][:-1]]]] = True
    return again[starts]


def _units(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows in order of keys, in units of about ``most`` bytes that cut no key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += int(pc.binary_length(batch.column(5)).to_numpy().sum())
        if size < most or not batch.num_rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = whole.column(0).to_numpy()
        border = int(np.searchsorted(keys, keys[-1]))
        if border:
            yield whole.slice(0, border)
            held = whole.slice(border).to_batches()
            size = sum(int(pc.binary_length(b.column(5)).to_numpy().sum()) for b in held)
    if held and (whole := pa.Table.from_batches(held)).num_rows:
        yield whole


def repeats_in_units(strings: DataFrame, length: int, unit: int = UNIT) -> DataFrame:
    """Runs of repeated starts among ``key, doc, row, at, n, bytes``, key by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units(batches, unit):
            doc, row, at, n = (rows.column(c).to_numpy() for c in (1, 2, 3, 4))
            order = np.empty(len(row), dtype=np.int64)
            order[np.lexsort((at, row, doc))] = np.arange(len(row))
            again = repeated_starts(rows.column(5).to_pylist(), n, order, length)
            of = np.repeat(np.arange(len(n)), n)[again]
            place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))[again]
            found = joined_runs(row[of], at[of] + place, np.ones(len(of), dtype=np.int64))
            columns = [pa.array(found[0]), *(pa.array(x.astype(np.int32)) for x in found[1:])]
            yield pa.RecordBatch.from_arrays(columns, ["row", "at", "n"])

    return (
        strings.repartition("key")
        .sortWithinPartitions("key")
        .select("key", "doc", "row", "at", "n", "bytes")
        .mapInArrow(run, _RUNS)
    )


def _with_text(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, row, text`` and ``wanted``, the list of all records of each row that has some."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("key", "at", "n")).alias("wanted"))
    return texts.select("doc", "row", "text").join(stored(lists), "row").select("doc", "row", "text", "wanted")


def strings_of(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``key, doc, row, at, n`` and the bytes of the strings of each record ``key, row, at, n``."""
    each = _with_text(texts, wanted)
    made = F.transform(
        "wanted",
        lambda own: F.struct(
            own["key"].alias("key"),
            own["at"].alias("at"),
            own["n"].alias("n"),
            F.substring(F.col("text"), own["at"] + 1, own["n"] + (length - 1)).alias("bytes"),
        ),
    )
    return each.select("doc", "row", F.inline(made))


def repeats_one_by_one(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Runs of repeated starts among records of frequent keys, each start by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for first in range(0, batch.num_rows, 50):
                part = batch.slice(first, 50)
                docs, rows, made = part.column(0).to_pylist(), part.column(1).to_pylist(), []
                for doc, row, text, own in zip(docs, rows, part.column(2), part.column(3), strict=True):
                    held = memoryview(text.as_py())
                    for record in own.as_py():
                        for at in range(record["at"], record["at"] + record["n"]):
                            made.append((digest(held[at : at + length]), doc, row, at))
                if made:
                    sums, doc, row, at = zip(*made, strict=True)
                    halves = np.frombuffer(b"".join(sums), dtype=np.int64).reshape(-1, 2)
                    columns = [halves[:, 0], halves[:, 1], np.array(doc), np.array(row), np.array(at, dtype=np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["low", "high", "doc", "row", "at"])

    schema = "low long, high long, doc long, row long, at int"
    starts = stored(_with_text(texts, wanted).mapInArrow(run, schema))
    place = F.struct("doc", "row", "at")
    firsts = stored(
        starts.groupBy("low", "high")
        .agg(F.min(place).alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )
    found = lookup_join(starts, firsts, ["low", "high"], "inner", seq="at")
    return found.filter(place != F.col("first")).select("row", "at", F.lit(1).alias("n"))


def repeated_runs(texts: DataFrame, length: int, most: int, chunk: int, unit: int) -> DataFrame:
    """``row, at, n``: all starts whose string also starts earlier, as runs in their texts."""
    whole = stored(records(texts, length, chunk), compression="zstd")
    keyed = whole.filter("key is not null")
    frequent = stored(keyed.groupBy("key").agg(F.count("*").alias("records")).filter(F.col("records") > most))
    made = [stored(whole.filter("key is null").select("row", "at", "n"))]
    if not frequent.isEmpty():
        keys = frequent.select("key")
        hot = lookup_join(keyed, keys, ["key"], "left_semi", seq="row")
        made.append(repeats_one_by_one(texts, hot, length))
        keyed = lookup_join(keyed, keys, ["key"], "left_anti", seq="row")
    of_key = Window.partitionBy("key")
    in_order = of_key.orderBy("bytes_hash", "doc", "row", "at")
    judged = stored(
        keyed.select(
            "*",
            (F.lag("bytes_hash").over(in_order) == F.col("bytes_hash")).alias("again"),
            (F.min("bytes_hash").over(of_key) != F.max("bytes_hash").over(of_key)).alias("several"),
        )
        .withColumn("again", F.coalesce("again", F.lit(False)))
        .filter("again or several")
        .drop("bytes_hash"),
        compression="zstd",
    )
    # All that is needed of the records is stored by now.
    discard(whole)
    made.append(judged.filter("again").select("row", "at", "n"))
    strings = strings_of(texts, judged.filter("not again"), length)
    made.append(repeats_in_units(strings, length, unit))
    return functools.reduce(DataFrame.union, made)


def cut_out(length: int):
    """Removes runs of starts from texts."""

    def kept(raw: bytes, runs: list[dict]) -> tuple[int, int, bytes]:
        n_removed = n_spans = end = 0
        summed = hashlib.sha256()
        for begin, stop in sorted((r["at"], r["at"] + r["n"] + length - 1) for r in runs):
            if begin > end or not n_spans:
                summed.update(raw[end:begin])
                n_spans += 1
                n_removed += stop - begin
                end = stop
            elif stop > end:
                n_removed += stop - end
                end = stop
        summed.update(raw[end:])
        return n_removed, n_spans, summed.digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                made, sizes = [], []
                for text, runs in zip(part.column(1), part.column(2), strict=True):
                    raw = text.as_py() or b""
                    sizes.append(len(raw))
                    made.append(kept(raw, runs.as_py() or []))
                removed, spans, digests = zip(*made, strict=True)
                columns = [
                    part.column(0),
                    *(pa.array(c, pa.int64()) for c in (sizes, removed, spans)),
                    pa.array([d.hex() for d in digests]),
                ]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def without_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    id_column: str = "doc_id",
    *,
    most: int = MOST_RECORDS,
    chunk: int = CHUNK,
    unit: int = UNIT,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a
    document of a smaller id, or earlier in the same one. Strings are judged on the texts as given, and
    never go across documents. ``n_spans`` counts the removed stretches after joining those
    that touch; ``kept_sha256`` is of the bytes that stay. A null text counts as empty; texts shorter than ``length``
    stay whole. Rows that share an id follow each other in the order in which they are read, and rows
    without an id come last; each has its row. Extra columns are ignored; no rows give an empty table. ``length``
    must be above ``GRAM``.
    """
    doc_id = F.col(id_column).cast("long")
    texts = stored(
        docs.select(
            doc_id.alias("doc_id"),
            F.coalesce(doc_id, F.lit(_LAST)).alias("doc"),
            F.monotonically_increasing_id().alias("row"),
            F.col("text").cast("binary").alias("text"),
        ),
        compression="zstd",
    )
    runs = repeated_runs(texts, length, most, chunk, unit)
    lists = runs.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    joined = texts.select("doc_id", "row", "text").join(stored(lists), "row", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.select("doc_id", "text", "runs").mapInArrow(cut_out(length), schema)
