"""Document listings: growing, shrinking, and the source of an extracted row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import stored
from ..functions.text import file_stem, known
from .joins import lookup_join
from .sizing import fits_broadcast


def append_documents(current: DataFrame, new: DataFrame) -> DataFrame:
    """The current listing followed by the new documents; nothing is deduplicated."""
    order = F.col("doc_seq")
    if isinstance(current.schema["doc_seq"].dataType, T.StructType):
        last = current.agg(F.max("doc_seq.arrival")).scalar()
        arrival = order["arrival"] + F.coalesce(last + 1, F.lit(0)).cast("int")
        moved = order.withField("arrival", arrival)
    else:
        last = current.agg(F.max("doc_seq")).scalar()
        moved = order + F.coalesce(last + 1, F.lit(0))
    return current.unionByName(new.withColumn("doc_seq", moved))


def remove_documents(documents: DataFrame, removed: DataFrame) -> DataFrame:
    """The listing without the documents whose ``doc_seq`` is in ``removed``."""
    gone = removed.select("doc_seq").distinct()
    return lookup_join(documents, gone, ["doc_seq"], "left_anti", spread=False)


def stem_sources(stems: DataFrame, documents: DataFrame, scope: list[str]) -> DataFrame:
    """First document whose lower-case name contains the stem, per scope and stem.

    Containment becomes an equi-join: document names are cut in all stretches
    that are as long as some stem, and the first document of each stretch is
    kept by a combining aggregation before stems and stretches meet.
    """
    name = F.lower(known(F.col("name")))
    lengths = stems.agg(F.collect_set(F.length("stem"))).scalar()
    # The empty stem is in every name; it needs one stretch only.
    last_start = F.when(F.col("_n") == 0, F.lit(1)).otherwise(F.length("_name") - F.col("_n") + 1)
    stretches = (
        documents.select(
            *scope,
            name.alias("_name"),
            F.struct("doc_seq", "name", "mime").alias("_doc"),
            lengths.alias("_lengths"),
        )
        .withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.length("_name"))))
        .withColumn("_at", F.explode(F.sequence(F.lit(1), last_start)))
        .withColumn("stem", F.substring("_name", F.col("_at"), F.col("_n")))
    )
    keys = [*scope, "stem"]
    small = fits_broadcast(stems)
    if small:
        stretches = stretches.join(F.broadcast(stems), keys, "left_semi")
    firsts = stretches.groupBy(*keys).agg(F.min("_doc").alias("documento"))
    # Without the filter above there may be far more stretches than the planner
    # expects of the documents.
    return stems.join(firsts if small else firsts.hint("merge"), keys)


def source_document(
    rows: DataFrame,
    documents: DataFrame,
    scope: list[str] | None = None,
    *,
    broadcast: bool | None = None,
) -> DataFrame:
    """Add ``documento`` (doc_seq, name, mime) and ``visible`` to each row.

    The first document by ``doc_seq`` that contains the stem of the row's
    ``sourceFile`` wins; it can be viewed only if it is an image. ``scope`` names
    columns, such as a batch, in which rows and documents must agree.
    """
    scope = scope or []
    stem = F.when(known(F.col("sourceFile")) != "", file_stem(F.col("sourceFile")))
    keyed = rows.withColumn("stem", stem)
    # Both are far smaller than the rows and are read several times.
    stems = stored(keyed.filter("stem is not null").select(*scope, "stem").distinct())
    sources = stored(stem_sources(stems, documents, scope))
    visible = F.coalesce(F.col("documento.mime").startswith("image/"), F.lit(False))
    return (
        lookup_join(keyed, sources, [*scope, "stem"], "left", broadcast=broadcast)
        .withColumn("visible", visible)
        .drop("stem")
    )
