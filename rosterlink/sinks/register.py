"""Append-only register of submitted participants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import known

# Fixed value: the columns of the register, in order.
COLUMNS = ["Id", "IdRef", "ParticipanteDNI", "Participante", "Cargo", "Area"]
SCHEMA = (
    "IdRef string, participantes array<struct<Id: string, ParticipanteDNI: string, "
    "Participante: string, Cargo: string, Area: string>>"
)


def _parsed(payloads: DataFrame) -> DataFrame:
    return payloads.withColumn("_sent", F.from_json("payload", SCHEMA))


def register_rows(payloads: DataFrame) -> DataFrame:
    """One register row per participant of each readable payload."""
    sent = _parsed(payloads).select(
        F.col("_sent.IdRef").alias("IdRef"), F.explode("_sent.participantes").alias("_p")
    )
    wide = sent.select("IdRef", "_p.*")
    return wide.select(*(known(F.col(c)).alias(c) for c in COLUMNS))


def rejected_payloads(payloads: DataFrame) -> DataFrame:
    """Payloads that are no JSON or hold no participant list."""
    return _parsed(payloads).filter("_sent.participantes is null").drop("_sent")


def replies(payloads: DataFrame) -> DataFrame:
    """The answer to each payload: whether it was taken, and why not."""
    read = F.col("_sent.participantes").isNotNull()
    refused = F.struct(
        F.lit(False).alias("success"), F.lit("payload without participants").alias("message")
    )
    reply = F.when(read, F.to_json(F.struct(F.lit(True).alias("success")))).otherwise(
        F.to_json(refused)
    )
    return _parsed(payloads).withColumn("reply", reply).drop("_sent")


def read_register(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} string" for c in COLUMNS)).parquet(path)


def append_register(payloads: DataFrame, path: str) -> None:
    register_rows(payloads).write.mode("append").parquet(path)
