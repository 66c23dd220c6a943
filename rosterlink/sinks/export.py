"""Semicolon-separated export of the matched rows of a view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import known
from ..operators.filters import sort_order
from ..operators.lookup import is_matched

# Fixed value: first line of an export.
HEADER = "DNI;NOMBRE OFICIAL;OCUPACION;AREA;METODO;ORIGEN"


def export_lines(view: DataFrame) -> DataFrame:
    """The view's matched rows with their export ``line``, without the header."""
    fields = [
        F.upper("dni"),
        F.upper("oficial.nombre"),
        F.upper("oficial.cargo"),
        F.upper("oficial.area"),
        F.col("method"),
        F.col("sourceFile"),
    ]
    # Missing text is an empty field: fields never move up.
    between = [known(fields[0]), *(F.concat(F.lit(";"), known(f)) for f in fields[1:])]
    line = F.concat(*between)
    return view.filter(is_matched()).withColumn("line", line)


def write_export(
    view: DataFrame, path: str, sort: str | None = None, direction: str = "asc"
) -> None:
    """Write header and lines in view order, over as many files as Spark sorts into.

    The files, read in the order of their names, are the export; the header is
    the first line of the first one, also if there is no match at all.
    """
    order = sort_order(sort, direction)
    kept = ["line", "seq"] + ([sort] if sort else [])
    body = export_lines(view).select(F.lit(1).alias("_part"), *kept)
    head = view.sparkSession.range(1).select(F.lit(0).alias("_part"), F.lit(HEADER).alias("line"))
    whole = head.unionByName(body, allowMissingColumns=True)
    whole.orderBy(F.col("_part").asc(), *order).select("line").write.text(path)
