"""Packing by concatenate and cut.

All documents' ids make one long line; it is cut every ``width`` ids. The place of a
document in the line comes from two-pass prefix sums: a running sum inside each
partition, and the partitions' totals. Nothing is shuffled. A document is encoded
once: its ids are stored with its running sum, and cut after the offsets are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.durable import stored

from .offsets import windows_of, with_global_start
from .tokenizer import encoder

WIDTH = 4096

# Rows handed on at a time, so that a batch of long texts stays small.
ROWS_AT_ONCE = 1000

_ENCODED = "doc_id long, part int, local_start long, n_tokens long, ids binary"


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id") -> DataFrame:
    """One row per document: ids as little-endian 32-bit integers with ``end_id``
    after them, and the running sum of ids in its partition. A null or empty text has
    only ``end_id``."""
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, encode_texts = TaskContext.get().partitionId(), 0, encoder(tokenizer).batch
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                ids = [x + end for x in encode_texts([x.as_py() or "" for x in batch.column(1)])]
                counts = [len(x) // 4 for x in ids]
                starts = []
                for n in counts:
                    starts.append(start)
                    start += n
                columns = [
                    batch.column(0),
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(ids, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "part", "local_start", "n_tokens", "ids"]
                )

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text"))
    return narrow.mapInArrow(encode, _ENCODED)


def cut(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pieces of encoded documents with ``global_start``: one row for each document
    and window that it touches.

    A document's pieces are cut from its ids one after the other, so a long document
    is never copied for each piece.
    """
    at, n = F.col("global_start"), F.col("n_tokens")

    def piece(window):
        begin = F.greatest(at, window * width)
        stop = F.least(at + n, (window + 1) * width)
        first, length = begin - at, stop - begin
        own = F.substring(F.col("ids"), (first * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct(
            first.cast("long").alias("start"),
            length.cast("long").alias("length"),
            F.crc32(own).alias("ids_crc32"),
            window.cast("long").alias("sequence_id"),
            (begin - window * width).cast("long").alias("offset"),
            own.alias("ids"),
        )

    pieces = F.transform(windows_of(at, n, width), piece)
    return rows.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.inline(pieces))


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, width: int = WIDTH, id_column: str = "doc_id"
) -> DataFrame:
    """Pieces of all documents in sequences of ``width`` ids.

    Columns: ``doc_id``, ``doc_tokens`` (with the end id), ``start`` (the document's
    ids before the piece), ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (in
    the sequence), ``ids`` (binary, little-endian 32-bit). All sequences but the last
    are full; the last is to be padded by less than ``width`` ids. Each row of ``docs``
    is packed by itself, also when ids repeat or are null; extra columns are ignored;
    no rows give no pieces.
    """
    table = stored(encoded(docs, tokenizer, end_id, id_column), compression="zstd")
    return cut(with_global_start(table), width)
