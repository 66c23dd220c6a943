"""Token ids in Parquet files that can be read in part.

One row per document, in ascending order of ids over all files. Ids are a list
column with a dictionary (at most as many entries as the vocabulary, so two bytes an
id before compression); document ids, counts and offsets rise slowly and are written as
differences. Row groups are bounded, pages are short and carry an index, so a
reader that asks for a few documents, or for counts only, reads little else.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlink.durable import shared_folder

from .offsets import with_global_start
from .tokenizer import encoder

ROWS_AT_ONCE = 1000

# Pre-tokens in a worker's table: nothing else shares the worker's memory here.
MOST_KEPT = 800_000

_FILE = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"

# Settings of the Parquet writer.
WRITER = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 * 2**20),
    "parquet.page.size": str(2**18),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
}


def write_ids(
    docs: DataFrame, tokenizer: str, end_id: int, path: str, id_column: str = "doc_id"
) -> None:
    """Encode whole texts and write them in ascending order of ids.

    Texts, not ids, are shuffled, once, by ranges of ids; each range is sorted, encoded
    and written as it stands. Null ids come first. Rows with the same id stay next to each other,
    in the order of the first 64 characters, then of a hash of their texts; equal rows may
    lie in several ranges, so that no id makes a large one.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, encode_texts = TaskContext.get().partitionId(), 0, encoder(tokenizer, MOST_KEPT).batch
        end = end_id.to_bytes(4, "little")
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                ids = [x + end for x in encode_texts([x or "" for x in batch.column(1).to_pylist()])]
                counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(counts)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                borders = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                columns = [
                    batch.column(0),
                    pa.array(np.full(len(ids), part, dtype=np.int32)),
                    pa.array(start + ends - counts),
                    pa.array(counts),
                    pa.ListArray.from_arrays(borders, values),
                ]
                start += int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "part", "local_start", "n_tokens", "ids"]
                )

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col("text"),
        F.substring("text", 1, 64).alias("_top"),
        F.xxhash64("text").alias("_hash"),
    ).withColumn("_deal", F.monotonically_increasing_id() % 1024)
    order = ["doc_id", "_top", "_hash", "_deal"]
    ordered = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(encode, _FILE).write.options(**WRITER).parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The files as a table; filters on ``doc_id`` and selected columns reach them."""
    return spark.read.schema(_FILE).parquet(path)


def digests(rows: DataFrame) -> DataFrame:
    """Add ``ids_crc32``, the checksum of a row's ids as little-endian 32-bit integers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
            borders = lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "ids_crc32"])

    narrow = rows.select("doc_id", F.struct("global_start", "n_tokens").alias("at"), "ids")
    schema = "doc_id long, at struct<global_start: long, n_tokens: long>, ids_crc32 long"
    return narrow.mapInArrow(add, schema).select("doc_id", "at.*", "ids_crc32")


def id_files(
    docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, id_column: str = "doc_id"
) -> DataFrame:
    """Write the files and read them back.

    Columns: ``doc_id``, ``global_start`` (ids of all documents before it),
    ``n_tokens`` (with the end id), ``ids``. A null or empty text has only the end id;
    extra columns are ignored; no rows give an empty table.
    """
    path = path or f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, tokenizer, end_id, path, id_column)
    return with_global_start(read_ids(docs.sparkSession, path))
