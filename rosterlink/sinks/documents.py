"""Documents as files under their own names.

Spark's writers name their files themselves, so documents are written by a data source of this
package, one file per row. A task writes each document beside its place and then renames it, so a file
is there as a whole or not at all; a task that runs again replaces its files by the same ones. When all
tasks are through, the job leaves the mark ``_SUCCESS``; a job that fails leaves none, and removes the files of
tasks that had finished. Names, not contents, pass the driver.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MARK = "_SUCCESS"


def _place(path: str):
    """File system and path inside it; any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """Names that a task has written."""

    names: list[str]


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        store, folder = _place(self.path)
        store.create_dir(folder, recursive=True)
        names = []
        for row in iterator:
            beside = posixpath.join(folder, f".{uuid.uuid4().hex}")
            with store.open_output_stream(beside) as file:
                file.write(row["content"] or b"")
            store.move(beside, posixpath.join(folder, row["name"]))
            names.append(row["name"])
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _place(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(posixpath.join(folder, MARK)):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _place(self.path)
        for message in messages:
            for name in message.names if message else []:
                store.delete_file(posixpath.join(folder, name))


class NamedFiles(DataSource):
    """Write-only: rows of ``name`` and ``content``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"])


def write_documents(documents: DataFrame, path: str) -> None:
    """Write each document's content under its name into a folder.

    Names must be there, must be unique, and must be names, not paths: else nothing is written. A missing content is an
    empty file. Files of other names that the folder holds stay.
    """
    name = F.col("name")
    bad = documents.filter(name.isNull() | (name == "") | name.contains("/") | name.startswith(".") | name.startswith("_"))
    repeated = documents.groupBy("name").count().filter("count > 1")
    if not bad.isEmpty() or not repeated.isEmpty():
        raise ValueError("documents need names of their own, without folders")
    documents.sparkSession.dataSource.register(NamedFiles)
    rows = documents.select("name", F.col("content").cast("binary").alias("content"))
    rows.write.format("named_files").mode("append").save(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether the last job that wrote the folder came through."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARK}")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
