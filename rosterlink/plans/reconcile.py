"""From recorded attempts to reconciled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..durable import stored
from ..operators.edits import apply_corrections
from ..operators.lookup import index_fits
from ..operators.nearest import link_by_name
from ..sources.responses import clean_responses, resolve_attempts, response_rows
from .view import view


def extract(attempts: DataFrame) -> DataFrame:
    """Rows of the winning answer of every batch."""
    return response_rows(clean_responses(resolve_attempts(attempts)))


def reconcile(
    rows: DataFrame,
    roster: DataFrame,
    corrections: DataFrame | None = None,
    correction_order: str | None = None,
) -> DataFrame:
    """Correct, link by name, and look up again through the linked dni.

    The rows are read twice, once for the names that are looked for.
    """
    if corrections is not None:
        rows = apply_corrections(rows, corrections, correction_order)
    small = index_fits(roster)
    return view(link_by_name(rows, roster, broadcast=small), roster, broadcast=small)


def reconcile_attempts(
    attempts: DataFrame,
    roster: DataFrame,
    corrections: DataFrame | None = None,
    correction_order: str | None = None,
) -> DataFrame:
    """The whole way from recorded attempts; their answers are parsed once."""
    return reconcile(stored(extract(attempts)), roster, corrections, correction_order)
