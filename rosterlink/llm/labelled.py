"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of the sample: documents, and bytes of one document (a longer one is left out
# of the sample, never of the scoring). At most 4,000 x 64 KB reach the driver, and
# some 14 MB with documents of usual length.
MOST_DOCUMENTS = 4000
MOST_BYTES = 2**16


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a row's label may not be learned from: crc32(id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(
    docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_DOCUMENTS
) -> list[tuple[str, int]]:
    """Texts with 0/1 labels, in the order of a hash of their ids.

    The sample is picked among the ids of ``labels`` alone; only texts of the ids picked
    are joined (``most`` ids of 8 bytes are broadcast). Rows that are held out, or have
    a null id or label, are not learned from; an id with several labels takes the lowest.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    one = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= MOST_BYTES)
    rows = texts.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    return [(r["text"], r["label"]) for r in rows.select("text", "label").limit(most).collect()]
