"""Appends that count once: staged files, and a log of those that count.

The rows of a submission are first written below ``data/<attempt>``, where no reader looks. Then one
file below ``commits/<key>`` names these files. The key is made from the content of all rows, so the
same submission has the same key whenever and however often it is run. Readers take the files that
the log names, and of several attempts with one key the lowest alone:

* cut off before its log entry, a submission does not count; it can be run again;
* run again after it, it finds its key and adds nothing;
* two runs at the same time may both write an entry, of which all readers take the same one.

An entry is one file written by one task, which appears as a whole when the job commits.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "key string, attempt string, file string, n_rows long"


class Commit(NamedTuple):
    """What became of a submission: its key, its rows, and whether it was added now."""

    key: str | None
    n_rows: int
    added: bool


def _paths(spark: SparkSession, pattern: str) -> list:
    """Status of the files or folders that match a pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return list(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or [])


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(rows: DataFrame, folder: str) -> str:
    """Write rows where no reader looks yet; returns the name of the attempt."""
    attempt = uuid.uuid4().hex
    rows.write.parquet(f"{folder}/data/{attempt}")
    return attempt


def _row_hash(columns: list[str], seed: int) -> Column:
    """Hash of all fields of a row; a missing field differs from an empty one."""
    fields = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return F.xxhash64(F.lit(seed), *fields)


def _entry(spark: SparkSession, folder: str, attempt: str) -> DataFrame:
    """The staged files, each with its rows and two sums of row hashes, whatever the order of rows."""
    staged = spark.read.parquet(f"{folder}/data/{attempt}")
    names = staged.columns
    hashed = staged.select(
        F.col("_metadata.file_name").alias("file"),
        _row_hash(names, 1).cast("decimal(38,0)").alias("one"),
        _row_hash(names, 2).alias("two"),
    )
    return hashed.groupBy("file").agg(
        F.count("*").alias("n_rows"), F.sum("one").alias("one"), F.bit_xor("two").alias("two")
    )


def commit(spark: SparkSession, folder: str, attempt: str) -> Commit:
    """Let a staged attempt count, unless its content counts already.

    An attempt without rows leaves no entry.
    """
    files = _entry(spark, folder, attempt)
    whole = files.agg(F.sum("n_rows"), F.sum("one"), F.bit_xor("two"))
    n_rows, one, two = whole.first()
    if not n_rows:
        _delete(spark, f"{folder}/data/{attempt}")
        return Commit(None, 0, False)
    key = spark.range(1).select(F.sha2(F.lit(f"{n_rows} {one} {two}"), 256)).first()[0]
    if _paths(spark, f"{folder}/commits/{key}/*/part-*"):
        _delete(spark, f"{folder}/data/{attempt}")
        return Commit(key, n_rows, False)
    entry = files.select(F.lit(key).alias("key"), F.lit(attempt).alias("attempt"), "file", "n_rows")
    entry.coalesce(1).write.json(f"{folder}/commits/{key}/{attempt}")
    return Commit(key, n_rows, True)


def append_once(rows: DataFrame, folder: str) -> Commit:
    """Append rows to the table in ``folder`` unless exactly these were appended before."""
    return commit(rows.sparkSession, folder, stage(rows, folder))


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """The log: one row per file that counts (``key``, ``attempt``, ``file``, ``n_rows``)."""
    if not _paths(spark, f"{folder}/commits/*/*/part-*"):
        return spark.createDataFrame([], ENTRY)
    log = spark.read.schema(ENTRY).json(f"{folder}/commits/*/*")
    lowest = log.groupBy("key").agg(F.min("attempt").alias("attempt"))
    return log.join(lowest, ["key", "attempt"])


def read_committed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows that count. Names of files (one per task of each submission) pass the driver, no rows."""
    path = F.concat(F.lit(f"{folder}/data/"), "attempt", F.lit("/"), "file")
    files = [r["path"] for r in committed(spark, folder).select(path.alias("path")).collect()]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files)


def remove_uncommitted(spark: SparkSession, folder: str, older_than_seconds: float) -> int:
    """Delete attempts that do not count and were written before the given time; returns their number.

    Submissions that take longer than that must not be running.
    """
    counted = {r["attempt"] for r in committed(spark, folder).select("attempt").distinct().collect()}
    now = spark._jvm.System.currentTimeMillis()
    removed = 0
    for status in _paths(spark, f"{folder}/data/*"):
        old = now - status.getModificationTime() >= older_than_seconds * 1000
        if old and status.getPath().getName() not in counted:
            _delete(spark, status.getPath().toString())
            removed += 1
    return removed
