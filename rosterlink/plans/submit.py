"""From a view to the register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.commits import Commit, append_once, read_committed
from ..sinks.payload import participants, refused
from ..sinks.register import COLUMNS

# What a row without a reference is told.
NO_REFERENCE = "IdRef is missing"


def submitted(shown: DataFrame, id_ref: Column) -> DataFrame:
    """Register rows of the view's matched participants.

    They go straight to the register: no list per reference, no text. Ids come from places in
    the reference, in row order.
    """
    people = participants(shown, id_ref).select("IdRef", "participante.*")
    return people.select(*COLUMNS)


def submit(shown: DataFrame, id_ref: Column, register: str) -> DataFrame:
    """Append the view's matched participants to the register.

    Returns the view's matched rows that were refused for want of a reference.
    """
    submitted(shown, id_ref).write.mode("append").parquet(register)
    return refused(shown, id_ref).withColumn("message", F.lit(NO_REFERENCE))


def submit_once(shown: DataFrame, id_ref: Column, register: str) -> tuple[Commit, DataFrame]:
    """Like :func:`submit`, to a register with a log (``sinks/commits.py``): a submission that
    is run again, after success or after being cut off, leaves each participant once.

    Returns what became of it, and the rows that were refused. Read the register with :func:`read_once`.
    """
    done = append_once(submitted(shown, id_ref), register)
    return done, refused(shown, id_ref).withColumn("message", F.lit(NO_REFERENCE))


def read_once(spark: SparkSession, register: str) -> DataFrame:
    """The participants of all submissions that count."""
    return read_committed(spark, register, ", ".join(f"{c} string" for c in COLUMNS))
