"""Corrections carried through a view by differences.

A view that is kept (stored rows with their roster person and status, and the number of rows of
each facet value) follows a log of corrections without being made again: only corrected rows are
looked up, and counts move by what these rows were before and are now. Rows that are not
corrected stay where they are: corrections are broadcast if their measured size allows, else a bitmap of their keys
tells which rows they can touch, and only those are shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import stored
from ..functions.text import known
from ..operators.joins import split_by_keys
from ..operators.sizing import fits_broadcast
from .view import view

# What a view adds to its rows.
ADDED = ["oficial", "estado", "dni_oficial", "nombre_oficial"]


class Kept(NamedTuple):
    """A view that is kept: its rows, and ``columna, valor, n`` of its facets."""

    rows: DataFrame
    counts: DataFrame
    facets: tuple[str, ...]


def _counted(rows: DataFrame, facets: tuple[str, ...], weight: int) -> DataFrame:
    """Rows of each value, as a difference."""
    fields = F.array(*(F.struct(F.lit(c).alias("columna"), known(F.col(c)).alias("valor")) for c in facets))
    each = rows.select(F.explode(fields).alias("f")).select("f.*")
    return each.groupBy("columna", "valor").agg((F.count("*") * weight).alias("n"))


def keep(rows: DataFrame, roster: DataFrame, facets: list[str]) -> Kept:
    """Look all rows up once and count their facets; ``estado`` is one of them in any case."""
    names = tuple(dict.fromkeys(["estado", *facets]))
    shown = stored(view(rows, roster))
    return Kept(shown, stored(_counted(shown, names, 1)), names)


def touched(
    rows: DataFrame, last: DataFrame, *, broadcast: bool | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows with a correction (with its ``_dni``), and the others, which are not moved."""
    if broadcast is None:
        broadcast = fits_broadcast(last)
    if broadcast:
        few = F.broadcast(last)
        return rows.join(few, "seq"), rows.join(F.broadcast(last.select("seq")), "seq", "left_anti")
    parts = split_by_keys(rows, last, ["seq"])
    if parts is None:
        return rows.join(last.hint("merge"), "seq"), rows.join(last.select("seq").hint("merge"), "seq", "left_anti")
    may, never = parts
    rest = may.join(last.select("seq").hint("merge"), "seq", "left_anti")
    return may.join(last.hint("merge"), "seq"), never.unionByName(rest)


def corrected(
    kept: Kept, corrections: DataFrame, order: str, roster: DataFrame, *, broadcast: bool | None = None
) -> Kept:
    """The view after a log of corrections (``seq``, ``dni`` and ``order``: the last one of a row counts).

    Corrections without a dni, and of rows that the view does not have change nothing.
    """
    latest = corrections.groupBy("seq").agg(F.max_by("dni", order).alias("_dni"))
    last = stored(latest.filter("_dni is not null"))
    old, rest = touched(kept.rows, last, broadcast=broadcast)
    old = stored(old)
    changed = old.withColumns({"dni": F.col("_dni"), "method": F.lit("MANUAL")}).drop("_dni", *ADDED)
    new = stored(view(changed, roster).select(*kept.rows.columns))
    moved = _counted(old, kept.facets, -1).unionByName(_counted(new, kept.facets, 1))
    counts = kept.counts.unionByName(moved).groupBy("columna", "valor").agg(F.sum("n").alias("n"))
    return Kept(rest.unionByName(new), stored(counts.filter("n != 0")), kept.facets)


def kept_summary(kept: Kept) -> DataFrame:
    """Total and unmatched rows, from the counts alone."""
    states = kept.counts.filter(F.col("columna") == "estado")
    out = F.sum(F.when(F.col("valor") == "FUERA", F.col("n")))
    return states.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(out, F.lit(0)).alias("fuera")
    )
