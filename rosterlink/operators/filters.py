"""Row predicates, facets, sorts and the roster search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    WHITE_SPACE,
    contains_text,
    full_trim,
    highlight,
    identity_key,
    known,
)
from .lookup import lookup
from .ranking import numbered

SEARCHED = ["nombre", "dni", "sourceFile"]
SORTABLE = ["nombre", "dni", "estado", "method", "sourceFile"]
STATES = ["OK", "FUERA"]


def only_unmatched(rows: DataFrame, roster: DataFrame) -> DataFrame:
    return lookup(rows, roster, "left_anti")


def text_filter(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose name, dni or source contains ``text``; no text, no filter."""
    if not text:
        return rows
    hit = F.lit(False)
    for c in SEARCHED:
        hit = hit | contains_text(known(F.col(c)), text)
    return rows.filter(hit)


def facet_filter(rows: DataFrame, facets: dict[str, list[str]]) -> DataFrame:
    """All columns must hold one of their selected values; no values, no filter."""
    for column, values in facets.items():
        if values:
            rows = rows.filter(F.col(column).isin(list(values)))
    return rows


def with_highlights(rows: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Add ``<column>_marcado`` with the occurrences of ``text`` marked."""
    columns = columns or ["nombre", "dni"]
    return rows.withColumns({f"{c}_marcado": highlight(known(F.col(c)), text) for c in columns})


def facet_values(rows: DataFrame, column: str, *, positions: bool = False) -> DataFrame:
    """Distinct non-empty values of a column in ascending order.

    The values of ``estado`` are fixed, whatever the rows hold.
    """
    value = F.col(column).alias("valor")
    if column == "estado":
        fixed = F.posexplode(F.array(*map(F.lit, STATES))).alias("pos", "valor")
        listed = rows.sparkSession.range(1).select(fixed)
        place = (F.col("pos") + 1).cast("long").alias("pos")
        return listed.select("valor", place) if positions else listed.select("valor")
    values = rows.select(value).filter(F.col("valor") != "").distinct()
    if positions:
        return numbered(values, [F.col("valor").asc()])
    return values.orderBy("valor")


def sort_order(column: str | None, direction: str = "asc", seq: str = "seq") -> list[Column]:
    """Order of one column, ignoring case; equal values keep the row order."""
    if column is None:
        return [F.col(seq).asc()]
    value = F.lower(known(F.col(column)))
    return [value.asc() if direction == "asc" else value.desc(), F.col(seq).asc()]


def roster_search(roster: DataFrame, text: str, count: int = 10) -> DataFrame:
    """First people, in roster order, whose name or dni contains the text."""
    query = full_trim(F.lower(F.lit(text)))
    if not text.strip(WHITE_SPACE):
        return roster.limit(0)
    in_name = F.lower(known(F.col("nombre"))).contains(query)
    in_dni = identity_key(F.col("dni")).contains(identity_key(query))
    return roster.filter(in_name | in_dni).orderBy("seq").limit(count)

