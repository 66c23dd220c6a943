"""From raw documents to packed sequences.

Documents that are toxic or fail the quality policy go, one document of each group of near
duplicates stays, and what is left is packed. Each stage gets all that the one before kept,
from a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlink.durable import only_last_stored, stored
from rosterlink.llm import packing, rules, sketches, toxicity
from rosterlink.llm.settings import PACKING_END, POLICY, SIMILAR, TOXIC, table, vocabulary
from rosterlink.operators.bitmaps import as_bitmaps, with_membership


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text is not toxic; learned from the labels in ``sf_dir``.

    A null or empty text is not toxic. Each row is judged by itself, also one that repeats or has
    no id; all columns stay as they are; no rows give no rows.
    """
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    return toxicity.reads(model, docs).filter(F.col("score") < TOXIC).select("row.*")


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy does not reject.

    A null or empty text has too few words and goes. Each row is judged by itself, also one that repeats or
    has no id; all columns stay as they are; no rows give no rows.
    """
    return rules.ledger(docs).filter(~rules.fails(POLICY)).select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id.

    Rows are told apart by a number of their own, so those that share an id or have none
    are reduced to one like any others. Texts without words stay. Which rows go is a set of bitmaps of
    their numbers, so the rows that stay are not moved.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    numbered = stored(docs.select(row, F.monotonically_increasing_id().alias("number")))
    texts = numbered.select("number", F.col("row.text").alias("text"))
    found = sketches.near_duplicates(texts, SIMILAR, "number").filter("not kept")
    others = stored(found.select(F.col("doc_id").alias("number"), "component_id"))
    lowest = others.select("component_id").distinct()
    members = others.union(lowest.select(F.col("component_id").alias("number"), "component_id"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "number")
    stay = (
        members.join(numbered.select("number", "row.doc_id"), "number")
        .groupBy("component_id")
        .agg(F.min(key).alias("first"))
        .select("first.number")
    )
    gone = stored(as_bitmaps(members.join(stay, "number", "left_anti"), "number"))
    return with_membership(numbered, "number", gone, "gone").filter("not gone").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4,096 ids.

    A null or empty text is its end id alone. Each row is packed by itself, also one that repeats or has no
    id; other columns are left out; no rows give no pieces.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), PACKING_END).drop("ids")


STAGES = [
    ("toxicity", without_toxic),
    ("quality rules", of_quality),
    ("near duplicates", without_near_duplicates),
    ("packing", packed),
]

# SQL cannot express the classifier and the tokenizer; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder.

    A stage's own tables are deleted when its result is stored; those of the last stage stay, as
    its result is read from them.
    """
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with only_last_stored(spark):
            rows = stored(stage(spark, rows, sf_dir))
    return STAGES[-1][1](spark, rows, sf_dir)
