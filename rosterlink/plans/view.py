"""The table view: lookup, filters, facets, status, sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import facet_filter, sort_order, text_filter, with_highlights
from ..operators.lookup import is_matched, lookup, status, with_known_text
from ..operators.ranking import numbered

# The columns of a row that hold text.
TEXT_COLUMNS = ["nro", "nombre", "dni", "ocupacion", "area", "sourceFile", "method"]

# Fixed value: what the view shows in place of a missing roster person.
PLACEHOLDER = "---"


def with_official(rows: DataFrame) -> DataFrame:
    """Add status, and roster dni and name or the placeholder, to looked-up rows."""
    return rows.withColumns(
        {
            "estado": status(),
            "dni_oficial": F.coalesce("oficial.dni", F.lit(PLACEHOLDER)),
            "nombre_oficial": F.coalesce("oficial.nombre", F.lit(PLACEHOLDER)),
        }
    )


def view(
    rows: DataFrame,
    roster: DataFrame,
    *,
    only_unmatched: bool = False,
    text: str = "",
    facets: dict[str, list[str]] | None = None,
    marks: bool = False,
    broadcast: bool | None = None,
) -> DataFrame:
    """Rows that pass all filters, with roster person and status; not sorted.

    Filters on the rows' own columns run below the lookup.
    """
    facets = dict(facets or {})
    states = facets.pop("estado", [])
    kept = facet_filter(text_filter(with_known_text(rows, TEXT_COLUMNS), text), facets)
    shown = with_official(lookup(kept, roster, "left", broadcast=broadcast))
    if only_unmatched:
        shown = shown.filter(~is_matched())
    shown = facet_filter(shown, {"estado": states})
    return with_highlights(shown, text) if marks else shown


def ordered(
    shown: DataFrame, sort: str | None = None, direction: str = "asc", *, positions: bool = False
) -> DataFrame:
    """Sort a view; with ``positions`` each row also carries its place from 1."""
    order = sort_order(sort, direction)
    return numbered(shown, order) if positions else shown.orderBy(*order)
