"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# ``file:`` folders that have been tried, with whether the driver saw all that executors wrote there.
_TRIED: dict[str, bool] = {}

# Small files that each core writes when a folder is tried.
FILES_PER_CORE = 3


def is_shared(spark: SparkSession, folder: str) -> bool:
    """Whether the driver sees what tasks on all executors write to a folder; tried once for each folder."""
    if folder not in _TRIED:
        path = f"{folder}/try-{uuid.uuid4().hex}"
        n = FILES_PER_CORE * spark.sparkContext.defaultParallelism
        written = spark.range(0, n, 1, n)
        written.write.parquet(path)
        _TRIED[folder] = spark.read.schema(written.schema).parquet(path).count() == n
        _delete(spark, path)
    return _TRIED[folder]


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    It is the checkpoint folder if the session names one, else a folder below the
    warehouse, which a cluster shares as well. On a cluster a ``file:`` path may be a mount that all
    machines share, or another disk on each of them: it is tried, and refused if files are missing.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    folder = folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    folder = folder.rstrip("/")
    if folder.startswith("file:") and not context.master.startswith("local") and not is_shared(spark, folder):
        raise ValueError(f"executors do not share {folder}: set spark.checkpoint.dir to a folder that they share")
    return folder


# Tables that this driver has written.
_MADE: list[str] = []


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_stored(spark: SparkSession) -> int:
    """Delete the tables that :func:`stored` has written so far; returns their number.

    Call it when the results that were made from them are written.
    """
    made = 0
    while _MADE:
        made += bool(_delete(spark, _MADE.pop()))
    return made


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`stored` has written, when nothing will read it any more."""
    names = {file.rsplit("/", 2)[1] for file in table.inputFiles()}
    for path in [p for p in _MADE if p.rsplit("/", 1)[1] in names]:
        _delete(table.sparkSession, path)
        _MADE.remove(path)


@contextmanager
def only_last_stored(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that :func:`stored` writes inside the block, but for the last one.

    For a step whose result is stored at the end of the block.
    """
    before = len(_MADE)
    yield
    for name in _MADE[before:-1]:
        _delete(spark, name)
    del _MADE[before:-1]


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Run ``df`` once and go on from a table in the shared folder.

    Unlike an RDD checkpoint, the table tells the planner its true size. ``options``
    go to the Parquet writer.
    """
    path = f"{shared_folder(df.sparkSession)}/rosterlink-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
