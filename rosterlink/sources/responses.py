"""Recorded extraction attempts: choosing the answer, cleaning it, reading its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import field, full_trim, known

# Header of an answer, and messages of failed attempts.
HEADER = "Nro;Apellidos y Nombres;DNI;Ocupacion;Area;SourceFile"
EMPTY_RESPONSE = "Respuesta vacía del modelo."
ALL_FAILED = "Fallaron todos los modelos intentados ("
LAST_ERROR = "). Último error: "
# Columns of an answer line, in order.
COLUMNS = ["nro", "nombre", "dni", "ocupacion", "area", "sourceFile"]
DEFAULT_METHOD = "DEFAULT"


def _succeeded():
    return F.col("error").isNull() & (known(F.col("response")) != "")


def resolve_attempts(attempts: DataFrame) -> DataFrame:
    """First successful attempt of each batch by ``model_rank``.

    White space is an answer: emptiness is judged before any cleaning. At equal ranks
    the first model by name wins; a model answers a batch once. Only batch, rank and model are aggregated; of the
    answers, the winning ones alone are joined, null batches included.
    """
    good = attempts.filter(_succeeded())
    best = good.groupBy("batch").agg(F.min(F.struct("model_rank", "model")).alias("_best"))
    best = best.select(
        F.col("batch").alias("_batch"),
        F.col("_best.model_rank").alias("_rank"),
        F.col("_best.model").alias("_model"),
    )
    won = (
        F.col("batch").eqNullSafe(F.col("_batch"))
        & F.col("model_rank").eqNullSafe(F.col("_rank"))
        & F.col("model").eqNullSafe(F.col("_model"))
    )
    return good.join(best, won, "left_semi").select(
        "batch", F.col("model").alias("modelUsed"), "response"
    )


def failed_batches(attempts: DataFrame) -> DataFrame:
    """Batches without a successful attempt: models tried, last error, message.

    Tried models are gathered as a set, which holds each candidate model once.
    """
    outcome = attempts.select(
        "batch",
        "model_rank",
        "model",
        _succeeded().alias("_ok"),
        F.coalesce(F.col("error"), F.lit(EMPTY_RESPONSE)).alias("_error"),
    )
    tried = F.array_join(F.transform(F.array_sort("_tried"), lambda m: m["model"]), ", ")
    return (
        outcome.groupBy("batch")
        .agg(
            F.bool_or("_ok").alias("_ok"),
            F.collect_set(F.struct("model_rank", "model")).alias("_tried"),
            F.max_by("_error", "model_rank").alias("last_error"),
        )
        .filter(~F.col("_ok"))
        .select("batch", tried.alias("tried"), "last_error")
        .withColumn(
            "message",
            F.concat(F.lit(ALL_FAILED), "tried", F.lit(LAST_ERROR), "last_error"),
        )
    )


def clean_responses(responses: DataFrame) -> DataFrame:
    """Drop code fences and outer white space; add the header if none is there."""
    text = known(F.col("response"))
    text = F.regexp_replace(text, r"(?i)\A```(csv|txt)?\n", "")
    text = F.regexp_replace(text, r"\n```\z", "")
    text = full_trim(text)
    has_header = F.lower(F.col("csv")).contains("sourcefile")
    return (
        responses.withColumn("csv", text)
        .withColumn(
            "csv",
            F.when(has_header, F.col("csv")).otherwise(F.concat(F.lit(HEADER + "\n"), "csv")),
        )
        .drop("response")
    )


def response_rows(cleaned: DataFrame) -> DataFrame:
    """Rows of each cleaned answer, in order; ``seq`` orders all batches.

    The first line is dropped unread. Every semicolon separates, missing fields
    are empty, and rows with neither name nor dni are dropped.
    """
    lines = cleaned.select("batch", F.posexplode(F.split("csv", "\n", -1)).alias("pos", "_line"))
    cells = lines.filter("pos >= 1").withColumn("_cells", F.split("_line", ";", -1))
    values = {c: field(F.col("_cells"), i) for i, c in enumerate(COLUMNS)}
    values["sourceFile"] = full_trim(values["sourceFile"])
    return (
        cells.select(
            F.struct("batch", "pos").alias("seq"),
            "batch",
            "pos",
            *(v.alias(c) for c, v in values.items()),
        )
        .filter((F.col("nombre") != "") | (F.col("dni") != ""))
        .withColumn("method", F.lit(DEFAULT_METHOD))
    )
