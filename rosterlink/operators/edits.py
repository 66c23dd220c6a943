"""Manual corrections of extracted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lookup_join
from .sizing import fits_broadcast


def apply_corrections(
    rows: DataFrame,
    corrections: DataFrame,
    order: str | None = None,
    *,
    broadcast: bool | None = None,
) -> DataFrame:
    """Set the dni of corrected rows and mark them ``MANUAL``.

    With ``order``, the last correction of each ``seq`` counts; without it each
    ``seq`` must occur once.
    """
    fixed = corrections.select("seq", F.col("dni").alias("_dni"))
    if order is not None:
        fixed = corrections.groupBy("seq").agg(F.max_by("dni", order).alias("_dni"))
    if broadcast is None:
        # The log bounds what is left of it.
        broadcast = fits_broadcast(corrections.select("seq", "dni"))
    corrected = F.col("_dni").isNotNull()
    return (
        lookup_join(rows, fixed, ["seq"], broadcast=broadcast, spread=False)
        .withColumns(
            {
                "dni": F.coalesce("_dni", "dni"),
                "method": F.when(corrected, F.lit("MANUAL")).otherwise(F.col("method")),
            }
        )
        .drop("_dni")
    )
