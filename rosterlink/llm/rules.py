"""Quality rules: a ledger of rule failures as bits.

Every rule is evaluated once for each document. The ledger keeps the measurements
and one bit per failed rule. A policy is a version with the bits that reject; applying
one, comparing versions or leaving a rule out is then bit arithmetic over the ledger,
without another look at a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words as the contracts define them: no space and none of tab to carriage return.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")

ROWS_AT_ONCE = 1000

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper_words",
    "n_number_words",
)


def n_repeat_words(words: list[str]) -> int:
    """Words that lie in a window of three words found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    number: dict = {}
    codes = np.array([number.setdefault(w, len(number)) for w in windows])
    twice = np.bincount(codes)[codes] > 1
    inside = np.zeros(n, dtype=bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= twice
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``."""
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        n_repeat_words(words),
        len(lines),
        sum(map(str.isupper, words)),
        sum(map(str.isdecimal, words)),
    )


def measured(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as it is, in ``row``, with ``MEASURES``; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                own = whole.slice(first, ROWS_AT_ONCE).column(0)
                made = [measure(x.as_py()) for x in own.field("text")]
                columns = [pa.array(c, pa.int64()) for c in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([own, *columns], ["row", *MEASURES])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    types = f"row {rows.schema['row'].dataType.simpleString()}, "
    return rows.mapInArrow(run, types + ", ".join(f"{m} long" for m in MEASURES))


# Name of each rule and the condition under which a document fails it. A rule's bit
# is its place here: add rules at the end, so that stored ledgers keep their meaning.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols > 0.1D * n_words",
    "repeated_lines": "n_dup_lines > 0.5D * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "upper_case": "n_upper_words > 0.3D * n_words",
    "numbers": "n_number_words > 0.5D * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules that reject."""

    version: str
    rejecting: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = list(RULES)
        return sum(1 << names.index(r) for r in self.rejecting)


BASE = Policy("base", ("few_words", "repeated_windows"))
V1 = Policy("v1", (*BASE.rejecting, "symbols", "repeated_lines", "upper_case"))
V2 = Policy("v2", (*V1.rejecting, "short_words", "long_words", "numbers"))
POLICIES = {p.version: p for p in (BASE, V1, V2)}


def ledger(docs: DataFrame) -> DataFrame:
    """``row``, the measurements and ``failed``: bit i is set if rule i failed.

    ``row`` holds all columns of ``docs``, whatever their names, so that what a policy keeps
    needs no join. A null or empty text has no words. Repeated rows and null ids are
    measured like any other; no rows give an empty ledger.
    """
    bits = F.lit(0).cast("long")
    for place, condition in enumerate(RULES.values()):
        bit = F.when(F.expr(condition), F.lit(1 << place)).otherwise(F.lit(0))
        bits = bits.bitwiseOR(bit.cast("long"))
    return measured(docs).withColumn("failed", bits)


def fails(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) != 0


def applied(entries: DataFrame, policies: list[Policy]) -> DataFrame:
    """Add ``kept_<version>`` for each policy."""
    return entries.withColumns({f"kept_{p.version}": ~fails(p) for p in policies})


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """One row per rule of the policy over the whole ledger.

    Columns: ``rule``, ``n_docs``, ``n_failed`` (documents that fail the rule),
    ``n_only`` (documents that this rule alone rejects: what leaving it out would
    give back), ``n_rejected`` (by the whole policy). Sums are taken per partition
    before anything is shuffled.
    """
    names = list(RULES)
    caught = F.col("failed").bitwiseAND(F.lit(policy.mask))

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0))

    sums = {"n_docs": F.count("*"), "n_rejected": count(caught != 0)}
    for r in policy.rejecting:
        bit = F.lit(1 << names.index(r))
        sums[f"failed_{r}"] = count(caught.bitwiseAND(bit) != 0)
        sums[f"only_{r}"] = count(caught == bit)
    totals = entries.agg(*(c.alias(k) for k, c in sums.items()))
    rows = F.array(
        *(
            F.struct(
                F.lit(r).alias("rule"),
                F.col("n_docs"),
                F.col(f"failed_{r}").alias("n_failed"),
                F.col(f"only_{r}").alias("n_only"),
                F.col("n_rejected"),
            )
            for r in policy.rejecting
        )
    )
    return totals.select(F.inline(rows))
