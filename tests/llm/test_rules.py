"""Quality rules against plain counting."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterlink.llm import rules

TEXT = st.text(st.sampled_from("ab A#*|%\n\t\x0b \x1c\xa0é1"), max_size=80)


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return {
        "n_words": len(words),
        "word_chars": sum(len(w) for w in words),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(inside),
    }


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_measures(text):
    made = dict(zip(rules.MEASURES, rules.measure(text), strict=True))
    assert {k: made[k] for k in plain(text)} == plain(text)


@pytest.fixture
def entries(spark):
    good = " ".join(f"word{i} goes" for i in range(40))
    texts = [None, "", "short", good, good + " ###" * 40, "\n".join([good] * 5), good.upper(),
             " ".join(["again"] * 90), "x " * 60 + good, "long" * 5000]
    rows = [(i % 9, t, "row", 1) for i, t in enumerate(texts)] + [(None, good, "row", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, failed int")
    return rules.ledger(docs)


def test_ledger_keeps_rows_and_base(entries):
    made = entries.select("row.*", "n_words", "n_repeat_words", rules.fails(rules.BASE).alias("f")).collect()
    assert len(made) == 11
    for r in made:
        p = plain(r.text)
        assert r.f == (p["n_words"] < 50 or 100 * p["n_repeat_words"] > 50 * p["n_words"])
        assert r["row"] == "row" and r.failed in (1, 2)


def test_policies_only_get_stricter(entries):
    made = rules.applied(entries, list(rules.POLICIES.values())).collect()
    assert all(r.kept_base >= r.kept_v1 >= r.kept_v2 for r in made)
    assert sum(r.kept_v1 for r in made) == 3


def test_ablations(entries):
    bits = [r.failed for r in entries.select("failed").collect()]
    names = list(rules.RULES)
    for policy in rules.POLICIES.values():
        made = {r["rule"]: r for r in rules.ablations(entries, policy).collect()}
        assert list(made) == list(policy.rejecting)
        for name, r in made.items():
            bit = 1 << names.index(name)
            assert r.n_docs == len(bits)
            assert r.n_failed == sum(bool(b & bit) for b in bits)
            assert r.n_only == sum((b & policy.mask) == bit for b in bits)
            assert r.n_rejected == sum(bool(b & policy.mask) for b in bits)


def test_no_rows(entries):
    none = rules.ledger(entries.select("row.doc_id", "row.text").filter(F.lit(False)))
    assert none.count() == 0 and rules.ablations(none, rules.BASE).first().n_failed == 0
