"""Roster lookup by normalized identity number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import identity_key, known
from .joins import lookup_join
from .sizing import fits_broadcast

PERSON = ["dni", "nombre", "cargo", "area"]


def first_per_key(df: DataFrame, key: Column | str, seq: str, values: list[str]) -> DataFrame:
    """The earliest row of each key, combined before the shuffle."""
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.alias("llave")).agg(
        F.min_by(F.struct(*values), seq).alias("primero")
    )


def roster_index(roster: DataFrame) -> DataFrame:
    """``llave`` and ``oficial``: the first roster row of each identity key."""
    people = with_known_text(roster, PERSON)
    return first_per_key(people, identity_key(F.col("dni")), "seq", PERSON).withColumnRenamed(
        "primero", "oficial"
    )


def index_fits(roster: DataFrame) -> bool:
    """Whether the index can be broadcast, measured on the roster before deduplication."""
    return fits_broadcast(roster.select(identity_key(F.col("dni")).alias("llave"), *PERSON))


def lookup(
    rows: DataFrame,
    roster: DataFrame,
    how: str = "left",
    *,
    broadcast: bool | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Match rows with the roster; ``left`` and ``inner`` add the struct ``oficial``.

    ``left_semi`` and ``left_anti`` keep the rows that have, or lack, a match.
    The measured roster bounds the index, which is never larger. With a large roster, rows whose key
    it cannot hold are told by a bitmap of its keys and stay where they are.
    """
    if broadcast is None:
        broadcast = index_fits(roster)
    options = {} if rows_per_task is None else {"rows_per_task": rows_per_task}
    if how in ("left_semi", "left_anti"):
        index = roster.select(identity_key(F.col("dni")).alias("llave")).distinct()
    else:
        index = roster_index(roster)
    keyed = rows.withColumn("llave", identity_key(F.col("dni")))
    joined = lookup_join(keyed, index, ["llave"], how, broadcast=broadcast, reduce=True, **options)
    return joined.drop("llave")


def is_matched() -> Column:
    return F.col("oficial").isNotNull()


def status(ok: str = "OK", out: str = "FUERA") -> Column:
    """Whether the row has a roster match, under either pair of labels."""
    return F.when(is_matched(), F.lit(ok)).otherwise(F.lit(out))


def with_known_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace missing text by empty strings, as every comparison expects."""
    return df.withColumns({c: known(F.col(c)) for c in columns if c in df.columns})


def summary(rows: DataFrame, roster: DataFrame, *, broadcast: bool | None = None) -> DataFrame:
    """Total and unmatched rows in one pass.

    With a large roster the rows are counted per key first, so that neither a
    heavy key nor whole rows cross the join.
    """
    if broadcast is None:
        broadcast = index_fits(roster)
    keys = roster.select(identity_key(F.col("dni")).alias("llave")).distinct()
    keys = keys.withColumn("en_padron", F.lit(True))
    keyed = rows.select(identity_key(F.col("dni")).alias("llave"))
    if broadcast:
        counted = keyed.withColumn("n", F.lit(1).cast("long")).join(
            F.broadcast(keys), "llave", "left"
        )
    else:
        counted = keyed.groupBy("llave").agg(F.count("*").alias("n")).join(keys, "llave", "left")
    missing = F.when(F.col("en_padron").isNull(), F.col("n")).otherwise(F.lit(0))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("fuera"),
    )
