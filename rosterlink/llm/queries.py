"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    convnet,
    counts,
    ids,
    lattice,
    packing,
    prefixes,
    rules,
    sketches,
    spans,
    sql,
    toxicity,
    urls,
    whitening,
)
from .settings import PACKING_END, POLICY, TOXIC, table, vocabulary

URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

# The split of the byte-level vocabularies, as their publisher gives it (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(table(spark, folder, "pages"), urls.rules_table(spark, URL_RULES))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    entries = rules.ledger(table(spark, folder, "documents").select("doc_id", "text"))
    return entries.select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        rules.fails(rules.BASE).alias("base_failed"),
        (~rules.fails(POLICY)).alias("kept"),
    )


def op3_lattice_hashing(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, folder, "embeddings"))


def op4_bottom_k(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.near_duplicates(table(spark, folder, "documents"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.token_counts(
        table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model")
    )


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    rows = ids.id_files(documents, vocabulary("byte_bpe_50k.json"), end_id=0)
    return ids.digests(rows).select(
        "doc_id", F.col("global_start").alias("start"), "n_tokens", "ids_crc32"
    )


def op7_prefix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    made = prefixes.round_trip(
        table(spark, folder, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), PATTERN
    )
    return made.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_byte_network(spark: SparkSession, folder: str) -> DataFrame:
    return convnet.quality_scores(
        table(spark, folder, "documents"), table(spark, folder, "labels"), limit=0.3
    )


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(
        table(spark, folder, "documents"), table(spark, folder, "labels"), limit=TOXIC
    )


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    pieces = packing.pack(documents, vocabulary("word_bpe_49k.json"), end_id=PACKING_END)
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return alignment.align(
        documents, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    ).select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        "n_best",
        "count_sum",
        "groups_sha256",
    )


def op12_repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    return spans.without_repeats(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_rules": op2_quality_rules,
    "op3_lattice_hashing": op3_lattice_hashing,
    "op4_bottom_k": op4_bottom_k,
    "op5_token_counts": op5_token_counts,
    "op6_token_files": op6_token_files,
    "op7_prefix_bpe": op7_prefix_bpe,
    "op8_byte_network": op8_byte_network,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_alignment": op11_alignment,
    "op12_repeated_spans": op12_repeated_spans,
    "op13_whitening": op13_whitening,
}

# SQL of those that SQL can express.
SQL: dict[str, str] = dict(sql.SQL)
