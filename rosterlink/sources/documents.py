"""Scanned documents from a folder, and the list of parts sent for a batch."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import stored
from ..functions.text import known, single_line_base64
from ..operators.cutting import greedy_parts
from ..operators.ranking import numbered
from ..operators.sizing import measured

# Media types that the public registry may lack on a machine (fixed values).
NEWER_TYPES = {
    "apng": "image/apng",
    "avif": "image/avif",
    "dib": "image/bmp",
    "heic": "image/heic",
    "heif": "image/heif",
    "ico": "image/vnd.microsoft.icon",
    "jfif": "image/jpeg",
    "jp2": "image/jp2",
    "jxl": "image/jxl",
    "tga": "image/x-tga",
    "webp": "image/webp",
}


def media_types() -> dict[str, str]:
    """Media type of each file extension: Python's registry, and the newer ones."""
    registry = mimetypes.MimeTypes()
    known_types = {**registry.types_map[False], **registry.types_map[True]}
    return {e.removeprefix("."): t for e, t in known_types.items()} | NEWER_TYPES


def is_accepted(mime: Column) -> Column:
    """Images and PDF files."""
    return mime.startswith("image/") | (mime == "application/pdf")


def accepted_documents(documents: DataFrame) -> DataFrame:
    return documents.filter(is_accepted(known(F.col("mime"))))


def _typed(files: DataFrame) -> DataFrame:
    types = F.create_map(*(F.lit(x) for pair in media_types().items() for x in pair))
    extension = F.lower(F.substring_index("path", ".", -1))
    return files.withColumn("mime", F.try_element_at(types, extension))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    )


def _any_case(extension: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in extension)


def read_documents(spark: SparkSession, path: str, arrival: int = 0) -> DataFrame:
    """Images and PDF files below a folder, in path order.

    The media type decides, whatever the extension. Files of other types are left out by
    name, so their content is never read; :func:`rejected_files` lists them. Spark's reader passes over
    empty files in both. The order
    comes from the path alone: contents, which are large, need no shuffle.
    """
    accepted = [
        e for e, t in media_types().items() if t.startswith("image/") or t == "application/pdf"
    ]
    names = ",".join(f"*.{_any_case(e)}" for e in accepted)
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"{{{names}}}")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return _typed(files).select(
        F.struct(F.lit(arrival).alias("arrival"), F.col("path")).alias("doc_seq"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size"),
        "mime",
        "content",
    )


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder that :func:`read_documents` leaves out: path, size, media type.

    The type is null where the extension is unknown. No content is read.
    """
    typed = _typed(_files(spark, path).select("path", "length"))
    refused = typed.filter(~F.coalesce(is_accepted(F.col("mime")), F.lit(False)))
    return refused.select("path", F.col("length").alias("size"), "mime")


def request_manifest(documents: DataFrame, scope: list[str]) -> DataFrame:
    """Documents of each batch numbered from 1, with the label sent before each.

    One row per document: a batch's contents are never gathered in one row. Numbers
    are found over names alone.
    """
    placed = numbered(documents, [F.col("doc_seq").asc()], scope)
    label = F.concat(F.lit("Archivo "), F.col("pos").cast("string"), F.lit(": "), F.col("name"))
    return placed.withColumn("etiqueta", label)


def request_parts(documents: DataFrame, scope: list[str], instruction: str) -> DataFrame:
    """All parts of each batch's request in order: ``parte`` counts from 1.

    Each document gives its label and then its content (``mime``, ``base64``); the
    instruction closes the batch. Numbers are found without the contents; these are
    joined by ``doc_seq``, and stay where they are if the numbers can be broadcast.
    """
    names = documents.select("doc_seq", *scope, "name")
    placed = stored(request_manifest(names, scope))
    labels = placed.select(
        *scope, (F.col("pos") * 2 - 1).alias("parte"), F.col("etiqueta").alias("text"), *_no_data()
    )
    contents = (
        documents.select("doc_seq", "mime", "content")
        .join(measured(placed.select("doc_seq", *scope, "pos")), "doc_seq")
        .select(
            *scope,
            (F.col("pos") * 2).alias("parte"),
            F.lit(None).cast("string").alias("text"),
            F.col("mime"),
            single_line_base64(F.col("content").cast("binary")).alias("base64"),
        )
    )
    closing = placed.groupBy(*scope).agg((F.max("pos") * 2 + 1).alias("parte"))
    closing = closing.select(*scope, "parte", F.lit(instruction).alias("text"), *_no_data())
    return labels.unionByName(contents).unionByName(closing)


def request_cuts(documents: DataFrame, scope: list[str], max_bytes: int) -> DataFrame:
    """``doc_seq``, ``scope``, ``pos`` and ``peticion``: the request, from 1, that takes each document of a batch.

    A request takes documents, in order, as long as their labels and base64 text stay within
    ``max_bytes``; a larger document is a request of its own. Sizes come from the lengths of contents, which are not moved.
    """
    sized = documents.select(
        "doc_seq", *scope, "name", F.octet_length(F.col("content").cast("binary")).alias("_bytes")
    )
    placed = request_manifest(sized, scope)
    # Base64 writes four characters for each three bytes begun.
    encoded = F.floor((F.coalesce("_bytes", F.lit(0)) + 2) / 3) * 4
    whole = placed.withColumn("_size", encoded + F.octet_length("etiqueta"))
    # A missing scope is a batch like any other.
    key = F.to_json(F.struct(*scope), {"ignoreNullFields": "false"}).alias("_batch")
    keyed = stored(whole.select("doc_seq", *scope, "pos", "_size", key))
    parts = greedy_parts(keyed, ["_batch"], "pos", "_size", max_bytes).withColumnRenamed("parte", "peticion")
    return keyed.join(parts, ["_batch", "pos"]).select("doc_seq", *scope, "pos", "peticion")


def _no_data() -> list[Column]:
    return [F.lit(None).cast("string").alias(c) for c in ("mime", "base64")]
