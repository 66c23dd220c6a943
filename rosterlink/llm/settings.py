"""What the registered queries and the pipeline use alike."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import rules

# Where the public vocabulary files lie on every machine.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")

# The policy that decides which documents stay.
POLICY = rules.V1

# From this score on a document is toxic.
TOXIC = 0.5

# From this similarity on (per cent) the pipeline takes documents as near duplicates.
SIMILAR = 80

# The end of a document in packed sequences.
PACKING_END = 2


def vocabulary(name: str) -> str:
    return f"{TOKENIZERS}/{name}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
